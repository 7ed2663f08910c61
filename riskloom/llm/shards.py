"""Shards of near equal bytes by sampled splitters, in DataFrame operations alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

ORDER = ("key", "tie", "seq")


def _range_of(items: DataFrame, bounds: list[tuple], key_type: str) -> DataFrame:
    """``items`` with ``range``, the number of bounds at or before a row, by halving steps through an array.

    The array comes as one row of text, so the plan stays small however many bounds there are.
    """
    if not bounds:
        return items.withColumn("range", F.lit(0))
    fields = [{"key": str(k) if k is not None else None, "tie": t, "seq": q} for k, t, q in bounds]
    kind = "array<struct<key:string,tie:bigint,seq:bigint>>"
    held = F.from_json(F.lit(json.dumps(fields)), kind).cast(f"array<struct<key:{key_type},tie:bigint,seq:bigint>>")
    at = F.struct(*ORDER)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return items.withColumn("range", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(
        F.try_element_at(held, lo + s) <= at, lo + s).otherwise(lo)))


def sampled_bounds(items: DataFrame, total: int, ranges: int, key_type: str, over_sample: int = 16, seed: int = 7) -> list[tuple]:
    """Splitters whose ranges hold about ``total / ranges`` bytes each.

    A row is drawn with a chance in proportion to its size, so about ``ranges * over_sample`` rows in all reach
    the driver whatever the input; every ``over_sample``-th in order is a splitter.  Ranges that turn out over twice
    the aim are drawn from and split again.  The order is total (key, text hash, number of the row), so a
    hot key or many equal rows split as well.
    """
    aim = max(1, total // ranges)

    def drawn(rows: DataFrame, round_: int) -> list[tuple]:
        chance = F.col("size") * F.lit(over_sample / aim)
        got = rows.where(F.rand(seed + round_) < chance).select(*ORDER).orderBy(*ORDER).collect()
        return [tuple(r) for r in got[over_sample // 2 :: over_sample]]

    bounds, round_ = drawn(items, 0), 0
    while True:
        placed = _range_of(items, bounds, key_type)
        full = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).where((F.col("bytes") > 2 * aim) & (F.col("rows") > 1))
        over = [r["range"] for r in full.select("range").collect()]
        round_ += 1
        more = drawn(placed.where(F.col("range").isin(over)), round_) if over else []
        if not set(more) - set(bounds):
            return bounds
        # a null key sorts first, as in Spark
        bounds = sorted({*bounds, *more}, key=lambda b: ((b[0] is not None, b[0] if b[0] is not None else 0), b[1], b[2]))


def split(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", rows_per_range: int = 1_000_000,
          least_ranges: int = 64, most_ranges: int = 16_384) -> DataFrame:
    """Shard and slot of each row by the law ``bytes``: key order is cut where the shards' sizes come nearest to equal.

    size is the text's UTF-8 bytes (null: none) plus 1.  A row goes to the shard in which the middle of its bytes
    falls, counted over all rows in key order, so shards differ by less than two rows' sizes, and the result doesn't
    depend on what was drawn.  Equal keys are ordered by text hash; null keys come first; slots have no gaps.
    Running sums are taken inside ranges of bounded size; the ranges' totals, at most a few thousand rows, give the bases.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    items = materialize(docs.select(F.col(key).alias("key"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
                                    F.xxhash64(text).alias("tie")).withColumn("seq", F.monotonically_increasing_id()), "sizes")
    key_type = dict(items.dtypes)["key"]
    row = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = max(1, row["bytes"])
    ranges = min(max(least_ranges, row["rows"] // rows_per_range), most_ranges)
    bounds = sampled_bounds(items, total, ranges, key_type)
    placed = _range_of(items, bounds, key_type)
    before, base = [0] * (len(bounds) + 2), [0] * (len(bounds) + 2)
    for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        before[r["range"] + 1], base[r["range"] + 1] = r["bytes"], r["rows"]
    for i in range(1, len(before)):
        before[i] += before[i - 1]
        base[i] += base[i - 1]
    inside = F.expr("row_number() over (partition by range order by key, tie, seq)")
    running = F.expr("sum(size) over (partition by range order by key, tie, seq rows unbounded preceding)")
    ranked = placed.select("*", inside.alias("nth"), running.alias("through"))
    start = F.element_at(F.array(*map(F.lit, map(int, before))).cast("array<bigint>"), F.col("range") + 1)
    rank = F.element_at(F.array(*map(F.lit, map(int, base))).cast("array<bigint>"), F.col("range") + 1) + F.col("nth") - 1
    middle = 2 * (start + F.col("through")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * total))).cast("int")
    dealt = materialize(ranked.select("key", "size", "crc", shard.alias("shard"), rank.alias("rank")), "dealt")
    firsts = {r["shard"]: r["first"] for r in dealt.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    first = F.element_at(F.array(*[F.lit(firsts.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard") + 1)
    return dealt.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
