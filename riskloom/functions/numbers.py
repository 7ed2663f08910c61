"""Numbers and units read out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.config import PROMPT_UNITS, UNITS


def last_number(text: Column) -> Column:
    """The last number in the text, ``$ , %`` removed first; NULL if there is none."""
    bare = F.translate(text, "$,%", "")
    found = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+\.?[0-9]*"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).cast("double")


def listed_unit(text: Column, whole_words: bool = False) -> Column:
    """First listed unit that occurs in the text.

    Substrings count by default, so any ``k`` means thousand; ``whole_words``
    asks for a unit that is not part of a longer word.
    """
    return unit_in(F.lower(text), whole_words)


def unit_in(low: Column, whole_words: bool = False) -> Column:
    """``listed_unit`` of a text already in lower case."""
    out = F.lit(None).cast("string")
    for unit, _ in reversed(UNITS):
        hit = (low.rlike(rf"(?:^|[^\p{{L}}]){unit}s?(?:$|[^\p{{L}}])") if whole_words
               else F.contains(low, F.lit(unit)))
        out = F.when(hit, F.lit(unit)).otherwise(out)
    return out


def unit_of(text: Column, whole_words: bool = False) -> Column:
    """The listed unit of a text that holds a number; NULL without a number."""
    return F.when(last_number(text).isNotNull(), listed_unit(text, whole_words))


def multiplier(unit: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in reversed(UNITS):
        out = F.when(unit == name, F.lit(factor)).otherwise(out)
    return out


def scaled_number(text: Column, whole_words: bool = False) -> Column:
    return last_number(text) * multiplier(unit_of(text, whole_words))


def prompt_unit(prompt: Column) -> Column:
    """Unit that the question asks for, by the first listed phrase."""
    return phrase_unit(F.lower(prompt))


def phrase_unit(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for phrase, unit in reversed(PROMPT_UNITS):
        out = F.when(F.contains(low, F.lit(phrase)), F.lit(unit)).otherwise(out)
    return out


def final_answer(text: Column) -> Column:
    """What follows the last ``####``, trimmed; the text itself without that mark."""
    from riskloom.functions.text import strip

    tail = F.element_at(F.split(text, "####"), -1)
    return F.when(F.contains(text, F.lit("####")), strip(tail)).otherwise(text)
