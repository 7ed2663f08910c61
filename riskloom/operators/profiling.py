"""Table profiles and contracts, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import MIN_ROWS_PER_DOMAIN


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df


def schema_contract(df: DataFrame, required: list[str], min_rows: int = MIN_ROWS_PER_DOMAIN) -> DataFrame:
    """NULLs per required column, the row count and whether it is enough."""
    require_columns(df, required)
    wide = df.agg(F.count("*").alias("n_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in required])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_null")) for c in required])
    return wide.select("n_rows", (F.col("n_rows") >= min_rows).alias("enough_rows"), F.explode(rows).alias("r")) \
        .select("r.column", "r.n_null", "n_rows", "enough_rows")


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: type, NULL count and share, smallest value as a stable sample."""
    wide = df.agg(F.count("*").alias("n_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
                  *[F.min(c).cast("string").alias(f"sample_{c}") for c in df.columns])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"),
                              F.col(f"null_{c}").alias("n_null"), F.col(f"sample_{c}").alias("sample"))
                     for i, (c, t) in enumerate(df.dtypes)])
    return wide.select("n_rows", F.explode(rows).alias("r")).select(
        "r.*", "n_rows", (100.0 * F.col("r.n_null") / F.col("n_rows")).alias("pct_null"))


def text_quality(df: DataFrame, question: str, answer: str, context: str,
                 min_rows: int = MIN_ROWS_PER_DOMAIN) -> DataFrame:
    """Filled counts, mean lengths and readiness checks of a question table."""
    size = lambda c: F.length(F.col(c))
    out = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(size(question) > 0).alias("n_questions"),
        F.count_if(size(answer) > 0).alias("n_answers"),
        F.count_if(size(context) > 100).alias("n_contexts"),
        F.count_if(size(context) > 50).alias("n_short_contexts"),
        F.avg(size(question)).alias("avg_question"), F.avg(size(answer)).alias("avg_answer"),
        F.avg(size(context)).alias("avg_context"))
    n = F.col("n_rows")
    return out.select("*", (n >= min_rows).alias("enough_rows"),
                      (F.col("n_questions") == n).alias("all_questions"),
                      (F.col("n_answers") == n).alias("all_answers"),
                      (F.col("n_short_contexts") > n * 0.95).alias("has_context")).drop("n_short_contexts")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def length_histogram(df: DataFrame, measures: dict[str, Column], bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each measure."""
    wide = df.select(*[c.cast("double").alias(n) for n, c in measures.items()])
    limits = wide.agg(*[F.min(n).alias(f"lo_{n}") for n in measures],
                      *[F.max(n).alias(f"hi_{n}") for n in measures])
    # equal lengths fold together before the limits are known
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("x"))
                                           for n in measures])).alias("r")).select("r.*")
    cells = long.groupBy("measure", "x").agg(F.count("*").alias("n"))
    edges = limits.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("measure"), F.col(f"lo_{n}").alias("lo"), F.col(f"hi_{n}").alias("hi"))
        for n in measures])).alias("r")).select("r.*")
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    # one row per named measure
    return cells.join(F.broadcast(edges), "measure").groupBy("measure", spot.cast("int").alias("bin")).agg(
        F.sum("n").alias("n"), F.min("x").alias("smallest"), F.max("x").alias("largest"))
