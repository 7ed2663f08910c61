"""Connected components of an edge table, by repeated joins over shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import drop_stage, materialize


def _pointed(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Point the neighbours of each node to the least of them (the star step of either kind).

    A hub's least neighbour is found by partial aggregation and joined back, so no hub's
    neighbours are ever gathered in one row.
    """
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    joined = edges.join(least, "a")
    if both_ways:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
                                              F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct()


def components(edges: DataFrame, in_file: int = 100_000) -> DataFrame:
    """(node, root) of every node of ``edges`` (two long columns a, b); the root is the least node.

    Large-star and small-star steps alternate until a round leaves the table as it is, which
    takes a number of rounds that grows with the logarithm of the largest component.  Every round is
    written to the shared folder; only a count and a checksum reach the driver.  A round has at most one file for each
    ``in_file`` edges of the round before, as every file costs each executor time and processes of its own.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                       F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, last = mark, now
        now = materialize(_pointed(_pointed(now, True), False).coalesce(-(-mark["n"] // in_file)), "edges")
        drop_stage(last)
