"""Joins that stay even when a key of the large side is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

# Rows of one key on the large side from which it is joined apart.
HEAVY = 1_000_000


def join_apart(large: DataFrame, lookup: DataFrame, on: str, heavy: int | None = None) -> DataFrame:
    """Inner join of ``large`` with a ``lookup`` of few rows a key.

    Keys are counted first (a partial aggregation).  There is at most one heavy key for each ``heavy`` rows, so
    their lookup rows are few and are broadcast, and the rows of heavy keys are never shuffled; the others meet by an
    ordinary join in which no key has more than ``heavy`` rows.
    """
    heavy = heavy or HEAVY
    hot = materialize(large.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy).select(on), "hot")
    if hot.isEmpty():
        return large.join(lookup, on)
    hot_lookup = lookup.join(F.broadcast(hot), on, "left_semi")
    rest = large.join(F.broadcast(hot), on, "left_anti").join(lookup, on)
    return large.join(F.broadcast(hot_lookup), on).unionByName(rest)
