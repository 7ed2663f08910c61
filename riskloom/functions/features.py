"""Per-text features of a prompt and domain codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.config import COMMON_ENTITIES, DOMAINS, QUESTION_WORDS, RARITY_SMOOTHING
from riskloom.functions.text import WORD


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lexical(toks: Column) -> dict[str, Column]:
    """Token count, distinct share (under two names) and mean token length."""
    n = F.size(toks)
    distinct = F.size(F.array_distinct(F.transform(toks, F.lower)))
    ratio = F.when(n > 0, distinct / n).otherwise(F.lit(0.0))
    chars = F.length(F.array_join(toks, ""))
    return {
        "token_count": n,
        "unique_token_ratio": ratio,
        "avg_word_length": F.when(n > 0, chars / n).otherwise(F.lit(0.0)),
        "lexical_diversity": ratio,
    }


def question_word(text: Column) -> Column:
    """Question word that starts earliest, inside words too; ``other`` for none."""
    low = F.lower(text)
    absent = 2**31 - 1
    spots = [F.struct(F.when(F.instr(low, w) > 0, F.instr(low, w)).otherwise(F.lit(absent)).alias("at"),
                      F.lit(i).alias("rank"), F.lit(w).alias("word"))
             for i, w in enumerate(QUESTION_WORDS)]
    first = F.least(*spots)
    return F.when(first["at"] < absent, first["word"]).otherwise(F.lit("other"))


def question_flags(word: Column) -> dict[str, Column]:
    return {f"qtype_{w}": (word == w).cast("int") for w in QUESTION_WORDS + ["other"]}


def entity_frequency(normalized: Column, known: Column | None = None) -> Column:
    """Rough frequency by a short list of common names, then by length."""
    size = F.length(normalized)
    guess = (F.when(F.lower(normalized).isin(*COMMON_ENTITIES), 0.8)
             .when(size <= 5, 0.6).when(size <= 10, 0.4).otherwise(0.2))
    return guess if known is None else F.coalesce(known, guess)


def entity_rarity(frequency: Column, smoothing: float = RARITY_SMOOTHING) -> Column:
    return -F.log(frequency + F.lit(smoothing))


def domain_match(domain: Column, domains: list[str] = DOMAINS) -> Column:
    """First configured domain that is a substring, in either case; NULL for none."""
    out = F.lit(None).cast("string")
    for d in reversed(domains):
        hit = F.contains(domain, F.lit(d)) | F.contains(F.lower(domain), F.lit(d.lower()))
        out = F.when(hit, F.lit(d)).otherwise(out)
    return out


def domain_flags(domain: Column, domains: list[str] = DOMAINS) -> dict[str, Column]:
    match = domain_match(domain, domains)
    return {f"domain_{d}": F.coalesce((match == d).cast("int"), F.lit(0)) for d in domains}


def domain_code(domain: Column, domains: list[str] = DOMAINS) -> Column:
    """Position in the list, -1 if unknown."""
    return (F.array_position(F.array(*[F.lit(d) for d in domains]), domain) - 1).cast("int")
