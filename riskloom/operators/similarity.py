"""Similarity of whole texts by joined counts, linear in their length.

Both texts of a pair are taken apart into word n-grams, each gram is counted on either side, and sums over
the counts give the measures.  The work splits by pair and gram, so one very long pair is shared by
many tasks; nothing compares the texts character by character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import words


def grams(each: Column, n: int = 1) -> Column:
    """n-grams of a column of words, repeats kept; fewer words, but not none, are one gram."""
    if n == 1:
        return each
    return F.when(F.size(each) <= n, F.when(F.size(each) > 0, F.array(F.array_join(each, " "))).otherwise(F.array().cast("array<string>"))) \
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(each) - (n - 1)), lambda i: F.array_join(F.slice(each, i, n), " ")))


def gram_similarity(pairs: DataFrame, ids: list[str], a: str, b: str, n: int = 1) -> DataFrame:
    """ids, ``dice`` and ``cosine`` of the gram counts of columns ``a`` and ``b``.

    ``dice`` is twice the shared grams, repeats counted, over all grams of both.  Two texts without a word are
    alike (1), one of them against words is not (0).  A pair with a NULL text has no row.  ``ids`` must be unique
    and without NULL.
    """
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*ids, words(F.col(a)).alias("_wa"), words(F.col(b)).alias("_wb"))
    sides = F.array(F.struct(F.lit(1).alias("a"), grams(F.col("_wa"), n).alias("g")), F.struct(F.lit(0).alias("a"), grams(F.col("_wb"), n).alias("g")))
    each = both.select(*ids, F.explode(sides).alias("_s")).select(*ids, F.col("_s.a").alias("_a"), F.explode_outer("_s.g").alias("_g"))
    real = F.col("_g").isNotNull()
    counts = each.groupBy(*ids, "_g").agg(F.sum(F.when(real, F.col("_a"))).alias("_x"), F.sum(F.when(real, 1 - F.col("_a"))).alias("_y"))
    x, y = F.coalesce(F.col("_x"), F.lit(0)).cast("double"), F.coalesce(F.col("_y"), F.lit(0)).cast("double")
    sums = counts.groupBy(*ids).agg(F.sum(F.least(x, y)).alias("_both"), F.sum(x + y).alias("_all"), F.sum(x * y).alias("_xy"),
                                    F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"))
    none = F.col("_all") == 0
    length = F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))
    return sums.select(*ids, F.when(none, 1.0).otherwise(2 * F.col("_both") / F.col("_all")).alias("dice"),
                       F.when(none, 1.0).when(length > 0, F.col("_xy") / length).otherwise(0.0).alias("cosine"))


def with_similarity(df: DataFrame, ids: list[str], a: Column, b: Column, name: str = "like", n: int = 1, measure: str = "dice") -> DataFrame:
    """``df`` with the similarity of two text columns; NULL where either is NULL."""
    pairs = df.select(*ids, a.alias("_a_text"), b.alias("_b_text"))
    found = gram_similarity(pairs, ids, "_a_text", "_b_text", n).select(*ids, F.col(measure).alias(name))
    return df.join(found, ids, "left")
