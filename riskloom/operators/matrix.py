"""The feature matrix: assembly, column sets and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import METADATA_COLUMNS
from riskloom.functions.features import domain_code, domain_flags
from riskloom.operators.ranking import exact_quantiles


def encode_domain(df: DataFrame, encoding: str = "onehot", domain: str = "domain") -> DataFrame:
    if encoding == "onehot":
        return df.select("*", *[c.alias(n) for n, c in domain_flags(F.col(domain)).items()])
    if encoding == "label":
        return df.withColumn("domain_label", domain_code(F.col(domain)))
    return df


def feature_matrix(labelled: DataFrame, epistemic: DataFrame, contextual: DataFrame,
                   key: str = "prompt_id") -> DataFrame:
    """Labelled prompts with every feature block; all joins share one key."""
    keep = [c for c in METADATA_COLUMNS if c in labelled.columns]
    spine = labelled.select(*keep)
    joined = spine.join(epistemic, key, "left").join(contextual, key, "left")
    wide = encode_domain(joined)
    features = [c for c in wide.columns if c not in METADATA_COLUMNS]
    return wide.select(*keep, *features)


def feature_columns(df: DataFrame) -> list[str]:
    """Everything but the metadata columns."""
    return [c for c in df.columns if c not in METADATA_COLUMNS]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def without_prefix(names: list[str], prefix: str = "domain_") -> list[str]:
    return [n for n in names if not n.startswith(prefix)]


# Name parts that put a feature into a group.
GROUP_PARTS = {
    "naive": ["naive_max_prob", "naive_perplexity", "mean_logprob", "min_logprob"],
    "semantic": ["semantic_entropy", "semantic_energy", "num_semantic_clusters"],
    "context": ["entity", "rarity", "token", "lexical", "parse", "qtype", "complexity"],
}
GROUP_TITLES = {
    "naive": "Baseline: Naive Confidence",
    "semantic": "Semantic Uncertainty",
    "context": "Context Only",
    "both": "Semantic + Context",
    "all": "Full Model",
}


def feature_groups(names: list[str]) -> dict[str, list[str]]:
    """Group title to features, by substring; a feature may be in several groups."""
    def having(group: str) -> list[str]:
        return [n for n in names if any(part in n for part in GROUP_PARTS[group])]

    semantic, context = having("semantic"), having("context")
    both = semantic + [n for n in context if n not in semantic]
    picked = {"naive": having("naive"), "semantic": semantic, "context": context, "both": both, "all": list(names)}
    return {GROUP_TITLES[g]: cols for g, cols in picked.items()}


def long_features(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep..., feature, x: one row per row and feature, NULL and NaN dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.feature", "_c.x") \
        .filter(F.col("x").isNotNull() & ~F.isnan("x"))


def _fills(df: DataFrame, columns: list[str], method: str) -> Column:
    """Struct of the fill values as one scalar subquery."""
    if method == "mean":
        one = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("s")).scalar()
    else:
        at = exact_quantiles(long_features(df, columns, []), ["feature"], [0.5])
        one = at.agg(F.struct(*[F.max(F.when(F.col("feature") == c, F.col("at"))).alias(c) for c in columns]).alias("s")).scalar()
    return one


def impute(df: DataFrame, columns: list[str], method: str = "mean", fit_on: DataFrame | None = None) -> DataFrame:
    """Fill or drop missing values of the named columns.

    ``fit_on`` gives the rows that set the fill values; pass the training rows to
    keep test rows out of them.
    """
    source = df if fit_on is None else fit_on
    if method == "drop":
        return df.dropna(subset=columns)
    given = df.columns
    if method == "zero":
        fills = {c: F.lit(0.0) for c in columns}
    elif method in ("mean", "median"):
        # stated once, then read by name: the subquery is planned once, not per column
        df = df.withColumn("_fills", _fills(source, columns, method))
        fills = {c: F.col("_fills").getField(c) for c in columns}
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), fills[c]).alias(c)
                       if c in fills else F.col(c) for c in given])


def impute_residual(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Median, then 0 for a column without any value."""
    filled = impute(df, columns, "median", fit_on)
    return filled.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in filled.columns])
