"""Feature filters and scores, each from one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import K_BEST
from riskloom.operators.matrix import long_features
from riskloom.operators.ranking import running_totals

MI_BINS = 10


def _unpack(wide: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """One wide row with ``{part}_{column}`` to one row per column."""
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}_{c}").alias(p) for p in parts]) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, variance, kept: population variance and whether it is positive."""
    wide = df.agg(*[F.var_pop(c).alias(f"variance_{c}") for c in columns])
    return _unpack(wide, columns, ["variance"]).withColumn(
        "kept", F.coalesce(F.col("variance") > 0, F.lit(False)))


def f_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One-way ANOVA F between the two classes."""
    aggs = []
    for c in columns:
        for y in (0, 1):
            x = F.when(F.col(label) == y, F.col(c).cast("double"))
            aggs += [F.count(x).alias(f"n{y}_{c}"), F.avg(x).alias(f"m{y}_{c}"), F.var_pop(x).alias(f"v{y}_{c}")]
    rows = _unpack(df.agg(*aggs), columns, ["n0", "m0", "v0", "n1", "m1", "v1"])
    n0, n1, m0, m1 = (F.col(x) for x in ("n0", "n1", "m0", "m1"))
    mean = (n0 * m0 + n1 * m1) / (n0 + n1)
    between = n0 * F.pow(m0 - mean, 2.0) + n1 * F.pow(m1 - mean, 2.0)
    within = n0 * F.col("v0") + n1 * F.col("v1")
    return rows.select("feature", F.when(within > 0, between / (within / (n0 + n1 - 2))).alias("score"))


def chi2_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Chi-square of the per-class sums of a feature; NULL if it has negative values."""
    aggs = [F.avg(label).alias("share")]
    for c in columns:
        aggs += [F.sum(F.when(F.col(label) == y, F.col(c))).alias(f"s{y}_{c}") for y in (0, 1)]
        aggs.append(F.min(c).alias(f"low_{c}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}_{c}").alias(p) for p in ("s0", "s1", "low")])
            for c in columns]
    rows = wide.select("share", F.explode(F.array(*rows)).alias("_r")).select("share", "_r.*")
    total = F.col("s0") + F.col("s1")
    e1, e0 = total * F.col("share"), total * (1 - F.col("share"))
    value = F.pow(F.col("s0") - e0, 2.0) / e0 + F.pow(F.col("s1") - e1, 2.0) / e1
    return rows.select("feature", F.when((F.col("low") >= 0) & (total > 0), value).alias("score"))


def label_cells(df: DataFrame, columns: list[str], label: str, keys: list[str] | None = None) -> DataFrame:
    """Per feature and distinct value: counts of both classes."""
    keys = keys or []
    long = long_features(df, columns, [*keys, label])
    return long.groupBy(*keys, "feature", "x").agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = MI_BINS) -> DataFrame:
    """Mutual information (nats) between the label and rank bins of a feature.

    Equal values share the bin of their first rank.
    """
    cells = label_cells(df, columns, label)
    ranked = running_totals(cells, ["feature"], [F.col("x")], {"n": F.col("n"), "pos": F.col("pos")})
    spot = F.floor(F.lit(bins) * (F.col("cum_n") - F.col("n")) / F.col("total_n"))
    table = ranked.groupBy("feature", spot.alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.max("total_n").alias("total"), F.max("total_pos").alias("total_pos"))

    def part(count: Column, margin: Column) -> Column:
        joint = count / F.col("total")
        return F.when(count > 0, joint * F.log(count * F.col("total") / (F.col("n") * margin))).otherwise(0.0)

    each = part(F.col("pos"), F.col("total_pos")) + part(F.col("n") - F.col("pos"), F.col("total") - F.col("total_pos"))
    return table.groupBy("feature").agg(F.greatest(F.sum(each), F.lit(0.0)).alias("score"))


SCORERS = {"mutual_info": mutual_information, "f_classif": f_scores, "chi2": chi2_scores}


def k_allowed(n_rows: int, n_columns: int, k_best: int = K_BEST) -> int:
    return min(k_best, max(1, n_rows // 5), n_columns)


def score_features(df: DataFrame, columns: list[str], label: str, method: str = "mutual_info",
                   k_best: int = K_BEST) -> DataFrame:
    """feature, score, place, selected over features with positive variance.

    An unknown method falls back to mutual information, and so does chi2 when any
    feature is negative.
    """
    kept = variances(df, columns).filter("kept").select("feature")
    scorer = SCORERS.get(method, mutual_information)
    if scorer is chi2_scores:
        low = df.agg(*[F.min(c) for c in columns]).first()
        if any(v is not None and v < 0 for v in low):
            scorer = mutual_information
    scores = scorer(df, columns, label).join(kept, "feature")
    n_rows = df.agg(F.count("*")).scalar()
    limit = F.least(F.lit(min(k_best, len(columns))), F.greatest(F.lit(1), F.floor(n_rows / 5)))
    # at most one row per feature reaches this window
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc_nulls_last(), "feature")
    return scores.withColumn("place", F.row_number().over(order)).withColumn("selected", F.col("place") <= limit)


def select_features(df: DataFrame, columns: list[str], label: str, method: str = "mutual_info",
                    k_best: int = K_BEST) -> list[str]:
    """Names of the selected features in their original order; reads one row per feature."""
    chosen = {r.feature for r in score_features(df, columns, label, method, k_best).filter("selected").collect()}
    return [c for c in columns if c in chosen]


def class_weight(df: DataFrame, label: str, multiplier: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """negatives, positives, weight of the positive class (1 without positives), of every ``by`` group if given."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.groupBy(*(by or [])).agg(neg.alias("negatives"), pos.alias("positives")).withColumn(
        "weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")).otherwise(1.0) * multiplier)
