"""Seeded samples, splits and folds with exact sizes.

Membership is decided by a hash of the row's id, so it does not depend on file
order or on the number of partitions.  Ids must be unique within a stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import SEED, TRAIN_RATIO
from riskloom.operators.ranking import hash_cut, hash_text, positions
from riskloom.session import is_stored, materialize


def _below_cut(df: DataFrame, keys: list[str], ids: list[str], quota: Column, seed: int) -> DataFrame:
    """Every row with ``_in``: does its hash lie at or below its stratum's cut?

    The cut table has one row per stratum (a class, perhaps a domain) and a known
    size; below the broadcast threshold the wide rows are not shuffled at all.
    """
    cut = hash_cut(df, keys, ids, quota, seed)
    h = hash_text(seed, *[F.col(i) for i in ids])
    if keys:
        joined = df.join(cut, keys, "left")
        return joined.withColumn("_in", F.coalesce(h <= F.col("cut"), F.lit(False))).drop("cut")
    return df.withColumn("_in", F.coalesce(h <= cut.select("cut").scalar(), F.lit(False)))


def sample_limit(df: DataFrame, ids: list[str], n: int, seed: int = SEED) -> DataFrame:
    """A seeded sample of exactly ``min(n, rows)`` rows."""
    quota = F.least(F.col("total_n"), F.lit(n))
    return _below_cut(df, [], ids, quota, seed).filter("_in").drop("_in")


def head_limit(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stratified_split(df: DataFrame, ids: list[str], label: str = "hallucination_label",
                     by: list[str] | None = None, ratio: float = TRAIN_RATIO, seed: int = SEED,
                     check: bool = False) -> DataFrame:
    """Add ``split``: ``round(ratio * n)`` rows of every class (and ``by`` group) train.

    ``check`` raises if the table holds a single class, at the cost of one pass
    over the label column.
    """
    if check:
        low, high = df.agg(F.min(label), F.max(label)).first()
        if low is None or low == high:
            raise ValueError("both classes are needed for a stratified split")
    keys = [*(by or []), label]
    marked = _below_cut(df, keys, ids, F.round(F.col("total_n") * F.lit(ratio)), seed)
    return marked.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def random_split(df: DataFrame, ids: list[str], by: list[str] | None = None, ratio: float = TRAIN_RATIO,
                 seed: int = SEED) -> DataFrame:
    """The unstratified fallback, within every ``by`` group if given."""
    marked = _below_cut(df, by or [], ids, F.round(F.col("total_n") * F.lit(ratio)), seed)
    return marked.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def route_split(df: DataFrame, ids: list[str], label: str = "hallucination_label") -> tuple[DataFrame, DataFrame]:
    """Train and test rows: by the ``split`` column if there is one, else by a new split."""
    routed = df if "split" in df.columns else stratified_split(df, ids, label)
    return routed.filter(F.col("split") == "train"), routed.filter(F.col("split") == "test")


def validation_split(train: DataFrame, ids: list[str], label: str = "hallucination_label",
                     min_rows: int = 20, seed: int = SEED, by: str | None = None) -> DataFrame:
    """Add boolean ``is_validation``: the last fifth of each class, if there are enough rows (of the ``by`` group)."""
    # total_n of the stratum decides the quota; the whole table or group decides whether to split
    quota = F.round(F.col("total_n") * F.lit(TRAIN_RATIO))
    if by is None:
        enough = train.agg((F.count("*") > min_rows)).scalar()
        marked = _below_cut(train, [label], ids, quota, seed + 1)
        return marked.withColumn("is_validation", enough & ~F.col("_in")).drop("_in")
    enough = train.groupBy(by).agg((F.count("*") > min_rows).alias("_enough"))
    marked = _below_cut(train, [by, label], ids, quota, seed + 1).join(enough, by, "left")
    return marked.withColumn("is_validation", F.coalesce("_enough", F.lit(False)) & ~F.col("_in")).drop("_in", "_enough")


def fold_count(n: Column, most: int = 5) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(most), F.floor(n / 10))).cast("int")


def stratified_folds(df: DataFrame, ids: list[str], label: str = "hallucination_label",
                     most: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold``: rows of each class dealt out in hash order over ``fold_count`` folds.

    The rows are written once, so that what they come from is computed once; ids and classes alone
    are put in order, and the folds are joined back.
    """
    stored = df if is_stored(df) else materialize(df, "folds")
    hashed = stored.select(*ids, label, hash_text(seed, *[F.col(i) for i in ids]).alias("_h"))
    dealt = positions(hashed, [label], [F.col("_h")], "_pos")
    k = fold_count(stored.agg(F.count("*")).scalar(), most)
    folds = dealt.select(*ids, label, (F.col("_pos") % k).cast("int").alias("fold"))
    if set(df.columns) == {*ids, label}:
        return folds.select(*df.columns, "fold")
    names = [*dict.fromkeys([*ids, label])]
    other = folds.select(*[F.col(c).alias(f"_f_{c}") for c in names], "fold")
    same = F.lit(True)
    for c in names:
        same = same & stored[c].eqNullSafe(other[f"_f_{c}"])
    return stored.join(other, same).select(*[stored[c] for c in df.columns], "fold")


def split_rates(df: DataFrame, label: str = "hallucination_label", by: list[str] | None = None) -> DataFrame:
    """Positive rate in percent per split, their gap in points and a flag above five."""
    keys = by or []

    def part(name: str, what: Column) -> Column:
        return F.when(F.col("split") == name, what)

    rate = lambda name: 100.0 * F.avg(part(name, F.col(label).cast("double")))
    out = df.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        rate("train").alias("train_rate"), rate("test").alias("test_rate"))
    gap = F.abs(F.col("train_rate") - F.col("test_rate"))
    return out.withColumn("gap", gap).withColumn("flagged", F.col("gap") > 5.0)


def label_distribution(df: DataFrame, label: str = "hallucination_label", by: list[str] | None = None) -> DataFrame:
    """Count and percentage of each class; the shares come from the counts alone."""
    from pyspark.sql import Window

    counts = df.groupBy(*(by or []), label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*[F.col(c) for c in (by or [])] or [F.lit(0)])
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(whole))
