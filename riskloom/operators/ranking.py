"""Order statistics that do not put a whole group into one task.

A window ordered over a group sorts that group in one task, which fails once a
key holds a large share of the rows.  Groups are counted first.  Those of up to
``ROWS`` rows are sorted as they are; larger ones are cut into runs of about
that many by a sampled range partitioning over the key and the whole order, so
no distribution of the values (ties aside, which fold or take a row number)
makes a run large.  Totals of the runs give the offsets, and only a run is ever
sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import is_stored, materialize

# Rows of a group, or of a run of a larger one, that one task sorts.
ROWS = 1 << 20
# Hex digits of a hash that one histogram resolves.
DIGITS = 4


def hash_text(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", *[i.cast("string") for i in ids], F.lit(str(seed))))


def _parts(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def _same(keys: list[str], other: DataFrame, df: DataFrame) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & df[k].eqNullSafe(other[f"_hot_{k}"])
    return out


def cut_order(df: DataFrame, keys: list[str], order: list[Column], rows: int | None = None) -> tuple[DataFrame, bool]:
    """``df``, stored, with ``_run``, and whether any group was cut.

    Runs of a key follow ``order``.  Rows that agree in all of it are told apart by their place in the
    stored table, so that even they can be dealt to several runs.
    """
    rows = rows or ROWS
    stored = df if is_stored(df) else materialize(df, "ordered")
    sizes = stored.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    large, n = sizes.agg(F.count("*"), F.sum("_n")).first()
    if not large:
        return stored.withColumn("_run", F.lit(0)), False
    # at most one key for each ``rows`` rows
    hot = sizes.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    cut, rest = stored, None
    if keys:
        cut = stored.join(hot, _same(keys, hot, stored), "left_semi")
        rest = stored.join(hot, _same(keys, hot, stored), "left_anti").withColumn("_run", F.lit(0))
    dealt = cut.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(
        max(2, 2 * -(-n // rows)), *[F.col(k) for k in keys], *order, "_place")
    runs = materialize(dealt.withColumn("_run", F.spark_partition_id()).drop("_place"), "runs")
    return (runs if rest is None else runs.unionByName(rest)), True


def running_totals(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column],
                   cut: bool | None = None) -> DataFrame:
    """Add ``cum_x`` (this row included) and ``total_x`` for every named sum, and ``_run``.

    ``cut``: what ``cut_order`` said, for a table that comes from it; else it is called here.
    """
    if cut is None:
        df, cut = cut_order(df, keys, order)
    given = [c for c in df.columns if c != "_run"]
    inside = Window.partitionBy(*_parts(keys), "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not cut:
        inside = Window.partitionBy(*_parts(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*_parts(keys))
        return df.select(*given, "_run", *[F.sum(c).over(inside).alias(f"cum_{n}") for n, c in sums.items()],
                         *[F.sum(c).over(whole).alias(f"total_{n}") for n, c in sums.items()])
    offsets = _run_offsets(df, keys, sums)
    joined = df.join(offsets, _same(keys, offsets, df) & (df["_run"] == offsets["_of"]))
    cums = [(F.col(f"_before_{n}") + F.sum(c).over(inside)).alias(f"cum_{n}") for n, c in sums.items()]
    return joined.select(*[df[c] for c in given], "_run", *cums, *[F.col(f"_total_{n}").alias(f"total_{n}") for n in sums])


def _run_offsets(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per key and run: ``_before_x`` from the runs ahead and ``_total_x`` of the key; a window over runs, not rows."""
    per = df.groupBy(*keys, "_run").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(*_parts(keys))
    ahead = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_run").alias("_of"),
        *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(n).over(whole).alias(f"_total_{n}") for n in sums])


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Number the rows of every key from 0 in the given order."""
    ranked = running_totals(df, keys, order, {"_row": F.lit(1)})
    return ranked.select(*df.columns, (F.col("cum__row") - 1).cast("bigint").alias(name))


def next_in_order(df: DataFrame, keys: list[str], order: list[Column], value: Column, cut: bool) -> Column:
    """``value`` of the next row in the order, looking into the next run where a run ends.

    ``df`` must carry ``_head``, as ``with_next_heads`` adds it.
    """
    inside = Window.partitionBy(*_parts(keys), *(["_run"] if cut else [])).orderBy(*order)
    return F.coalesce(F.lead(value).over(inside), F.col("_head"))


def with_next_heads(df: DataFrame, keys: list[str], order: Column, descending: bool, value: Column, cut: bool) -> DataFrame:
    """Add ``_head``: ``value`` of the first row of the run after this one; NULL in the last run."""
    if not cut:
        return df.withColumn("_head", F.lit(None))
    pick = F.max_by if descending else F.min_by
    heads = df.groupBy(*keys, "_run").agg(pick(value, order).alias("_first"))
    following = Window.partitionBy(*_parts(keys)).orderBy("_run")
    heads = heads.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_run").alias("_of"), F.lead("_first").over(following).alias("_head"))
    return df.join(heads, _same(keys, heads, df) & (df["_run"] == heads["_of"])).select(*[df[c] for c in df.columns], "_head")


def hash_cut(df: DataFrame, keys: list[str], ids: list[str], quota: Column, seed: int, rows: int | None = None) -> DataFrame:
    """The hash below which exactly ``quota`` rows of each key fall.

    ``quota`` is an expression over ``total_n``.  A histogram of the leading digits of the hash finds the bucket
    that holds the cut; while such a bucket has more than ``rows`` rows, the next digits of its rows are counted.
    Only the last bucket is ranked.  The result has one row per key: keys, ``cut``.  Both small
    tables are written to the shared folder, so that the optimizer knows their
    size and need not shuffle the rows they are joined to.
    """
    rows = rows or ROWS
    hashed = df.select(*keys, hash_text(seed, *[F.col(i) for i in ids]).alias("_h"))
    last = Window.partitionBy(*_parts(keys)).orderBy(F.col("_digits").desc())
    digits, level, edge = 0, hashed, None
    while True:
        digits += DIGITS
        counted = level.groupBy(*keys, F.substring("_h", 1, digits).alias("_digits")).agg(F.count("*").alias("_n"))
        whole = Window.partitionBy(*_parts(keys))
        ahead = whole.orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counted.select(*keys, "_digits", "_n", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("before_n"), F.sum("_n").over(whole).alias("total_n"))
        if edge is None:
            wanted = offsets.withColumn("_want", quota.cast("bigint"))
        else:
            wanted = offsets.join(edge.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_take").alias("_want")).alias("e"),
                                  _same_names(keys))
        edge = materialize(wanted.filter(F.col("before_n") < F.col("_want")).withColumn("_r", F.row_number().over(last)).filter("_r = 1")
                           .select(*keys, "_digits", "_n", (F.col("_want") - F.col("before_n")).alias("_take")), "edge")
        held = edge.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_digits").alias("_of"), "_take")
        level = hashed.join(held, _same(keys, held, hashed) & (F.substring("_h", 1, digits) == F.col("_of"))).select(*keys, "_h", "_take")
        if digits >= 32 or (edge.agg(F.max("_n")).first()[0] or 0) <= rows:
            break
    inside = Window.partitionBy(*_parts(keys)).orderBy("_h")
    ranked = level.withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") <= F.col("_take"))
    return materialize(ranked.groupBy(*keys).agg(F.max("_h").alias("cut")), "cut")


def _same_names(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    return out


def value_cells(long: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Count equal values once: keys, value, ``n``.  Copies of a value fold together before anything is sorted."""
    return long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def exact_quantiles(long: DataFrame, keys: list[str], probs: list[float], value: str = "x") -> DataFrame:
    """Exact quantiles with linear interpolation: keys, ``q``, ``at``.

    Two order statistics are read off running counts of distinct values, so the
    cost is one shuffle of the distinct values, whatever their number and however they crowd.
    """
    cells = value_cells(long, keys, value)
    ranked = running_totals(cells, keys, [F.col(value)], {"n": F.col("n")})
    spot = lambda q: F.lit(float(q)) * (F.col("total_n") - 1)
    below, upto = F.col("cum_n") - F.col("n"), F.col("cum_n")

    def holds(k: Column) -> Column:
        return (below <= k) & (k < upto)

    aggs = []
    for i, q in enumerate(probs):
        aggs += [F.max(F.when(holds(F.floor(spot(q))), F.col(value))).alias(f"_l{i}"),
                 F.max(F.when(holds(F.ceil(spot(q))), F.col(value))).alias(f"_h{i}")]
    aggs.append(F.max("total_n").alias("total_n"))
    found = ranked.groupBy(*keys).agg(*aggs)
    points = [F.struct(F.lit(float(q)).alias("q"),
                       (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}"))
                        * (spot(q) - F.floor(spot(q)))).alias("at"))
              for i, q in enumerate(probs)]
    return found.select(*keys, F.explode(F.array(*points)).alias("_p")).select(*keys, "_p.q", "_p.at")
