"""Features of the prompt text: known names, their rarity, words, question type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import CONTEXT_COLUMNS, ENTITY_TYPES, RARE_FREQUENCY
from riskloom.functions import features as X
from riskloom.functions.text import strip_punct, words
from riskloom.operators.joins import join_apart
from riskloom.session import is_stored, materialize


# Names that are broadcast; a larger gazetteer is joined by shuffles.
MOST_NAMES = 2_000_000


def windows(tokens: Column, most: int) -> Column:
    """At each token: the token, up to ``most`` tokens from it on joined by one blank, and how many those are."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        F.element_at(tokens, i).alias("head"), F.array_join(F.slice(tokens, i, most), " ").alias("window"),
        F.least(F.lit(most), n - i + 1).alias("left")))


def extract_entities(prompts: DataFrame, gazetteer: DataFrame, key: str = "prompt_id",
                     text: str = "prompt") -> DataFrame:
    """key, text_normalized, label, n: names of the gazetteer found in a text and how often.

    The gazetteer is written once, as it is counted, cut and looked up.  A token that begins no name is dropped at once; at the others only runs as long as a name
    with that beginning are formed, and equal runs of a text fold before they meet the names.  A gazetteer of up to
    ``MOST_NAMES`` names (counted first) is broadcast, so nothing but names that were found is shuffled; beyond it beginnings
    and runs are joined, those that very many texts share apart from the rest.
    """
    gazetteer = gazetteer if is_stored(gazetteer) else materialize(gazetteer.select("text_normalized", "label"), "names")
    size = F.size(F.split("text_normalized", " "))
    n_names, most = gazetteer.agg(F.count("*"), F.max(size)).first()
    heads = gazetteer.groupBy(F.substring_index("text_normalized", " ", 1).alias("head")).agg(F.collect_set(size).alias("sizes"))
    small = n_names <= MOST_NAMES
    toks = F.transform(words(F.lower(F.col(text))), strip_punct)
    at = prompts.select(key, toks.alias("_t")).select(key, F.explode(windows(F.col("_t"), most or 1)).alias("_w")).select(key, "_w.*")
    begun = at.join(F.broadcast(heads), "head") if small else join_apart(at, heads, "head")
    long = begun.select(key, "window", F.explode(F.filter("sizes", lambda n: n <= F.col("left"))).alias("_size"))
    runs = long.select(key, F.call_function("substring_index", F.col("window"), F.lit(" "), F.col("_size")).alias("text_normalized"))
    runs = runs.groupBy(key, "text_normalized").agg(F.count("*").alias("n")) if not small else runs
    found = runs.join(F.broadcast(gazetteer), "text_normalized") if small else join_apart(runs, gazetteer, "text_normalized")
    if not small:
        return found.select(key, "text_normalized", "label", "n")
    return found.groupBy(key, "text_normalized", "label").agg(F.count("*").alias("n"))


def entity_rarity(entities: DataFrame, key: str = "prompt_id", aggregation: str = "mean",
                  frequencies: DataFrame | None = None) -> DataFrame:
    """Rarity summaries, counts and type flags of prompts that hold a name.

    ``frequencies`` (text_normalized, frequency) replaces the guess where known.
    """
    known = None
    if frequencies is not None:
        entities = entities.join(frequencies, "text_normalized", "left")
        known = F.col("frequency")
    freq = X.entity_frequency(F.col("text_normalized"), known)
    scored = entities.withColumn("_f", freq).withColumn("_r", X.entity_rarity(F.col("_f")))
    mean = F.sum(F.col("_r") * F.col("n")) / F.sum("n")
    pick = {"mean": mean, "max": F.max("_r"), "min": F.min("_r")}.get(aggregation, mean)
    return scored.groupBy(key).agg(
        pick.alias("avg_entity_rarity"), F.max("_r").alias("max_entity_rarity"), F.min("_r").alias("min_entity_rarity"),
        F.sum("n").alias("num_entities"),
        F.sum(F.when(F.col("_f") < RARE_FREQUENCY, F.col("n")).otherwise(0)).alias("num_rare_entities"),
        *[F.max((F.col("label") == t).cast("int")).alias(f"entity_type_{t}") for t in ENTITY_TYPES])


def text_features(prompts: DataFrame, key: str = "prompt_id", text: str = "prompt") -> DataFrame:
    """Lexical features and question flags; no shuffle."""
    toked = prompts.select(key, text, X.tokens(F.col(text)).alias("_t"), X.question_word(F.col(text)).alias("_q"))
    cols = {**X.lexical(F.col("_t")), **X.question_flags(F.col("_q"))}
    return toked.select(key, *[c.alias(n) for n, c in cols.items()])


def contextual_features(prompts: DataFrame, entities: DataFrame, key: str = "prompt_id",
                        text: str = "prompt", compat: bool = False) -> DataFrame:
    """All context columns, one row per prompt.

    A prompt without names has zeros; ``compat`` leaves its type flags NULL, to be
    imputed later as the published pipeline did.
    """
    rarity = entity_rarity(entities, key)
    joined = text_features(prompts, key, text).join(rarity, key, "left")
    out = []
    for name in CONTEXT_COLUMNS:
        if name in rarity.columns and not (compat and name.startswith("entity_type_")):
            out.append(F.coalesce(F.col(name), F.lit(0)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(key, *out)
