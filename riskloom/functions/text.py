"""Text columns: tokens, overlaps and similarities."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters a Unicode-aware split() treats as white space.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
# Fixed value: ASCII punctuation.
PUNCT = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
WORD = r"[\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """White-space separated words, empties removed, repeats kept."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(words(F.lower(text)))


def without(term_array: Column, stopwords: list[str]) -> Column:
    return F.array_except(term_array, F.array(*[F.lit(w) for w in stopwords]))


def strip_symbols(text: Column) -> Column:
    """Drop everything but letters, digits, underscore and white space."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x85\p{Z}]", "")


def strip_punct(text: Column) -> Column:
    """Drop ASCII punctuation from both ends."""
    return F.regexp_replace(text, f"^{PUNCT}+|{PUNCT}+$", "")


def meaningful_terms(text: Column, stopwords: list[str]) -> Column:
    """Stopwords go first, then outer punctuation, then words of two letters or fewer."""
    bare = F.transform(without(terms(text), stopwords), strip_punct)
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) > 2))


def overlap(candidate: Column, reference: Column) -> Column:
    """Share of the reference's terms that the candidate holds; 0 for no terms."""
    shared = F.size(F.array_intersect(candidate, reference)).cast("double")
    return F.when(F.size(reference) > 0, shared / F.size(reference)).otherwise(F.lit(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length; 1 for two empty texts.  Stays in the JVM."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1.0 - F.levenshtein(a, b) / longer).otherwise(F.lit(1.0))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


# Bands of the bounded comparison; the second is tried only where the first was not enough.
BANDS = (64,)


def edit_at_least(a: Column, b: Column, least: Column) -> Column:
    """``edit_ratio`` where it reaches ``least``; NULL where it does not.

    ``least`` allows so many edits.  Pairs whose lengths differ by more, and a ``least`` over 1, cost no
    comparison; the others are compared in a narrow band around the diagonal first, then in one as wide
    as the edits allowed.  The engine still walks along both texts for every row of the table, so for texts of a million
    characters use ``operators.similarity``, which is linear.
    """
    longer = F.greatest(F.length(a), F.length(b))
    # a hair more than the bound, so that rounding never loses a pair that is just alike enough
    allowed = F.floor((1.0 - least) * longer + 1e-6).cast("int")
    allowed = F.least(allowed, longer)

    def within(most: Column, rest: Column) -> Column:
        return _let(F.call_function("levenshtein", a, b, F.least(most, allowed)),
                    lambda d: F.when(d >= 0, d).when(allowed <= most, F.lit(None)).otherwise(rest))

    distance = within(allowed, F.lit(None).cast("int"))
    for band in reversed(BANDS):
        distance = within(F.lit(band), distance)
    distance = F.when((allowed >= 0) & (F.abs(F.length(a) - F.length(b)) <= allowed), distance)
    ratio = F.when(longer > 0, 1.0 - distance / longer).when(least <= 1, F.lit(1.0))
    return F.when(ratio >= least, ratio)


@F.pandas_udf(T.DoubleType())
def _matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
        for x, y in zip(a, b)
    ], dtype="float64")


def matcher_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio (Ratcliff/Obershelp), the measure the thresholds were tuned for.

    Not symmetric; pass the response first.  Whole texts, Arrow batches.  NULL on
    either side skips the comparison, so guard the inputs with ``when``.
    """
    return _matcher_ratio(a, b)


SIMILARITIES = {"matcher": matcher_ratio, "edit": edit_ratio}


def similarity(mode: str, a: Column, b: Column) -> Column:
    try:
        return SIMILARITIES[mode](a, b)
    except KeyError:
        raise ValueError(f"unknown similarity {mode!r}; use one of {sorted(SIMILARITIES)}") from None
