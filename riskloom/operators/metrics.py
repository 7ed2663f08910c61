"""Ranking, calibration and selective-prediction metrics.

Everything starts from score cells: one row per key and distinct score with the
counts of positives and negatives.  Partial aggregation does that before the
only shuffle, and no later step sees single rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import ARC_MAX_REJECTION, ARC_POINTS, ECE_BINS, SWEEP
from riskloom.operators.ranking import cut_order, next_in_order, running_totals, with_next_heads
from riskloom.session import materialize

KEYS = ["model", "domain"]


def score_cells(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, p, pos, neg."""
    return scored.groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).alias("pos"),
                                          F.count_if(F.col("y") == 0).alias("neg"))


def stored_cells(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Score cells written once, for several metrics over them."""
    return materialize(score_cells(scored, keys), "cells")


def _pos() -> Column:
    return F.col("pos")


def _neg() -> Column:
    return F.col("neg")


def confusion_from_cells(cells: DataFrame, keys: list[str] = KEYS, threshold: float = 0.5) -> DataFrame:
    up = F.col("p") >= threshold
    return cells.groupBy(*keys).agg(
        F.sum(F.when(up, 0).otherwise(_neg())).alias("tn"),
        F.sum(F.when(up, _neg()).otherwise(0)).alias("fp"),
        F.sum(F.when(up, 0).otherwise(_pos())).alias("fn"),
        F.sum(F.when(up, _pos()).otherwise(0)).alias("tp"))


def confusion_matrix(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """TN, FP, FN, TP from labels and predicted labels; one class is no error."""
    def both(y: int, pred: int) -> Column:
        return F.count_if((F.col("y") == y) & (F.col("pred") == pred))

    return scored.groupBy(*keys).agg(both(0, 0).alias("tn"), both(0, 1).alias("fp"),
                                     both(1, 0).alias("fn"), both(1, 1).alias("tp"))


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1, specificity; 0 where a denominator is 0."""
    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return {
        "accuracy": share(tp + tn, tn + fp + fn + tp),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "specificity": share(tn, tn + fp),
    }


def class_metrics(confusion: DataFrame) -> DataFrame:
    out = rates(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    return confusion.select("*", *[c.alias(n) for n, c in out.items()])


def auroc(cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Area under ROC, ties count half; NULL when one class is absent."""
    ranked = running_totals(cells, keys, [F.col("p")], {"pos": _pos(), "neg": _neg()})
    below = (F.col("cum_neg") - F.col("neg")).cast("double")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def roc_curve(cells: DataFrame, keys: list[str] = KEYS, drop_collinear: bool = True) -> DataFrame:
    """keys, k, fpr, tpr, threshold; starts at (0, 0) with an infinite threshold.

    A point is dropped when its own step and the next one are the same, i.e. it
    lies on the line through its neighbours; the first and last points stay.
    """
    order = [F.col("p").desc()]
    cells, cut = cut_order(cells, keys, order)
    ranked = running_totals(cells, keys, order, {"pos": _pos(), "neg": _neg()}, cut)
    # the step after a run's last cell is the first step of the next run
    step = F.struct("pos", "neg")
    points = with_next_heads(ranked, keys, F.col("p"), True, step, cut)
    points = points.withColumn("next_step", next_in_order(points, keys, order, step, cut))
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    if drop_collinear:
        points = points.filter(first | F.col("next_step").isNull() | (F.col("next_step") != step))

    def share(cum: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(cum) / F.col(total))

    body = points.select(*keys, "_run", share("cum_neg", "total_neg").alias("fpr"),
                         share("cum_pos", "total_pos").alias("tpr"), F.col("p").alias("threshold"))
    numbered = running_totals(body, keys, [F.col("threshold").desc()], {"k": F.lit(1)}, cut)
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("fpr"),
                             F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")))
    row = F.struct(F.col("cum_k").cast("bigint").alias("k"), "fpr", "tpr", "threshold")
    rows = F.when(F.col("cum_k") == 1, F.concat(start, F.array(row))).otherwise(F.array(row))
    return numbered.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def arc_curve(cells: DataFrame, keys: list[str] = KEYS, points: int = ARC_POINTS,
              max_rejection: float = ARC_MAX_REJECTION) -> DataFrame:
    """Accuracy at 0.5 of the most confident rows left at each rejection rate.

    Rows of equal confidence are taken by score, then label, so the curve is
    defined by the cells alone: keys, k, rejection_rate, n_keep, accuracy.
    """
    step = max_rejection / (points - 1)
    conf = F.abs(F.col("p") - 0.5)
    by_conf = cells.select(*keys, "p", "pos", "neg", conf.alias("conf"))
    right = F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    ranked = running_totals(by_conf, keys, [F.col("conf").desc(), F.col("p")], {"n": F.col("pos") + F.col("neg"), "right": right})
    size = F.col("pos") + F.col("neg")
    start = F.col("cum_n") - size

    def keep(total: Column, k: Column) -> Column:
        return F.floor(total * (F.lit(1.0) - k * F.lit(step))).cast("bigint")

    cuts = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(
        k.alias("k"), keep(F.col("total_n"), k).alias("n_keep")))
    mine = F.filter(cuts, lambda c: (c["n_keep"] > start) & (c["n_keep"] <= F.col("cum_n")))
    hits = ranked.withColumn("_cut", F.explode(mine))
    taken = F.col("_cut.n_keep") - start
    zeros = F.least(taken, F.col("neg"))
    right_taken = F.when(F.col("p") >= 0.5, taken - zeros).otherwise(zeros)
    hits = hits.select(*keys, F.col("_cut.k").alias("k"),
                       ((F.col("cum_right") - right + right_taken) / F.col("_cut.n_keep")).alias("accuracy"))
    totals = cells.groupBy(*keys).agg(F.sum(size).alias("total_n"))
    grid = totals.select(*keys, "total_n",
                         F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return grid.join(hits, [*keys, "k"], "left").select(
        *keys, "k", (F.col("k") * F.lit(step)).alias("rejection_rate"),
        keep(F.col("total_n"), F.col("k")).alias("n_keep"), "accuracy")


def arc_area(curve: DataFrame, keys: list[str] = KEYS, points: int = ARC_POINTS,
             max_rejection: float = ARC_MAX_REJECTION) -> DataFrame:
    """Trapezoid area of the curve; NULL if any point is undefined."""
    step = max_rejection / (points - 1)
    weight = F.when((F.col("k") == 0) | (F.col("k") == points - 1), step / 2).otherwise(step)
    return curve.groupBy(*keys).agg(
        F.when(F.count("accuracy") == points, F.sum(F.col("accuracy") * weight)).alias("auc_arc"))


def bin_of(p: Column, bins: int = ECE_BINS) -> Column:
    """Index of the half-open bin ``(lo, hi]`` that holds p; NULL for p = 0."""
    width = 1.0 / bins
    out = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        out = F.when((p > i * width) & (p <= (i + 1) * width), F.lit(i)).otherwise(out)
    return out


def calibration_bins(cells: DataFrame, keys: list[str] = KEYS, bins: int = ECE_BINS) -> DataFrame:
    """keys, bin, lo, hi, acc, conf, n; empty bins have acc NULL and conf at the centre."""
    width = 1.0 / bins
    per = cells.groupBy(*keys, bin_of(F.col("p"), bins).alias("bin")).agg(
        F.sum(_pos() + _neg()).alias("n"), F.sum(_pos()).alias("hits"),
        F.sum(F.col("p") * (_pos() + _neg())).alias("psum"))
    # p = 0 keeps its key in the grid although it is in no bin
    grid = per.select(*keys).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lo, hi = F.col("bin") * F.lit(width), (F.col("bin") + 1) * F.lit(width)
    return grid.join(per, [*keys, "bin"], "left").select(
        *keys, "bin", lo.alias("lo"), hi.alias("hi"),
        (F.col("hits") / F.col("n")).alias("acc"),
        F.coalesce(F.col("psum") / F.col("n"), (lo + hi) / 2).alias("conf"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def ece_from_bins(bins: DataFrame, totals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Weighted gap; ``totals`` holds ``total_n``, which also counts p = 0."""
    gap = F.sum(F.when(F.col("n") > 0, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0))
    return (bins.groupBy(*keys).agg(gap.alias("_gap")).join(totals, keys)
            .select(*keys, (F.col("_gap") / F.col("total_n")).alias("ece")))


def simple_scores(cells: DataFrame, keys: list[str] = KEYS, bins: int = ECE_BINS) -> DataFrame:
    """Counts, Brier score and calibration error in one aggregation per key."""
    size = _pos() + _neg()
    p = F.col("p")
    up = p >= 0.5
    aggs = [
        F.sum(size).alias("n"),
        F.sum(F.when(up, 0).otherwise(_neg())).alias("tn"),
        F.sum(F.when(up, _neg()).otherwise(0)).alias("fp"),
        F.sum(F.when(up, 0).otherwise(_pos())).alias("fn"),
        F.sum(F.when(up, _pos()).otherwise(0)).alias("tp"),
        F.sum(_pos() * F.pow(p - 1.0, 2.0) + _neg() * F.pow(p, 2.0)).alias("_sq"),
    ]
    which = bin_of(p, bins)
    for i in range(bins):
        # hits minus summed scores of the bin: n * (acc - conf)
        aggs.append(F.sum(F.when(which == i, _pos() - p * size)).alias(f"_g{i}"))
    gap = sum((F.abs(F.coalesce(F.col(f"_g{i}"), F.lit(0.0))) for i in range(1, bins)),
              F.abs(F.coalesce(F.col("_g0"), F.lit(0.0))))
    return cells.groupBy(*keys).agg(*aggs).select(
        *keys, "n", "tn", "fp", "fn", "tp",
        (gap / F.col("n")).alias("ece"), (F.col("_sq") / F.col("n")).alias("brier"))


def ece(cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return simple_scores(cells, keys).select(*keys, "ece")


def brier(cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return simple_scores(cells, keys).select(*keys, "brier")


def metrics_bundle(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every scalar metric per key in one row."""
    return bundle_of_cells(stored_cells(scored, keys), keys)


def bundle_of_cells(cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    base = class_metrics(simple_scores(cells, keys))
    area = arc_area(arc_curve(cells, keys), keys)
    return base.join(auroc(cells, keys), keys).join(area, keys)


def compare_models(bundle: DataFrame) -> DataFrame:
    """One row per model and set, best AUROC first, missing ones last."""
    return bundle.select(*KEYS, "auroc", "auc_arc", "ece", "accuracy", "precision", "recall", "f1") \
        .orderBy(F.col("auroc").desc_nulls_last(), *KEYS)


def threshold_sweep(cells: DataFrame, keys: list[str] = KEYS, thresholds=SWEEP) -> DataFrame:
    """Metrics at each threshold (inclusive), in one aggregation; ``best`` marks top F1."""
    aggs = []
    for i, t in enumerate(thresholds):
        up = F.col("p") >= t
        aggs += [F.sum(F.when(up, 0).otherwise(_neg())).alias(f"tn{i}"),
                 F.sum(F.when(up, _neg()).otherwise(0)).alias(f"fp{i}"),
                 F.sum(F.when(up, 0).otherwise(_pos())).alias(f"fn{i}"),
                 F.sum(F.when(up, _pos()).otherwise(0)).alias(f"tp{i}")]
    wide = cells.groupBy(*keys).agg(*aggs)
    rows = []
    for i, t in enumerate(thresholds):
        cm = [F.col(f"{n}{i}") for n in ("tn", "fp", "fn", "tp")]
        rows.append(F.struct(F.lit(t).alias("threshold"),
                             *[c.alias(n) for n, c in zip(("tn", "fp", "fn", "tp"), cm)],
                             *[c.alias(n) for n, c in rates(*cm).items()]))
    listed = wide.select(*keys, F.array(*rows).alias("_rows"))
    top = F.array_max(F.transform(F.col("_rows"), lambda r: F.struct(
        r["f1"].alias("f1"), (-r["threshold"]).alias("t"))))
    return (listed.withColumn("_best", -top["t"]).select(*keys, "_best", F.explode("_rows").alias("_r"))
            .select(*keys, "_r.*", (F.col("_r.threshold") == F.col("_best")).alias("best")))


def integrity(bundle: DataFrame, roc: DataFrame, arc: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Recompute checks over finished metric tables, one row per key."""
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    again = rates(tn, fp, fn, tp)
    curve = roc.withColumn("bucket", F.floor(F.col("k") / 1024))
    inside = Window.partitionBy(*keys, "bucket").orderBy("k")
    falls = (F.col("fpr") < F.lag("fpr").over(inside)) | (F.col("tpr") < F.lag("tpr").over(inside))
    edge = (curve.withColumn("_falls", falls)
            .groupBy(*keys, "bucket").agg(
                F.count_if("_falls").alias("drops"),
                F.count_if((F.col("fpr") < 0) | (F.col("fpr") > 1) | (F.col("tpr") < 0) | (F.col("tpr") > 1)).alias("out"),
                F.min("fpr").alias("f0"), F.max("fpr").alias("f1_"),
                F.min("tpr").alias("t0"), F.max("tpr").alias("t1")))
    over = Window.partitionBy(*keys).orderBy("bucket")
    edge = edge.withColumn("_e", (F.col("f0") < F.lag("f1_").over(over)) | (F.col("t0") < F.lag("t1").over(over)))
    roc_ok = edge.groupBy(*keys).agg(
        ((F.sum("drops") + F.count_if("_e")) == 0).alias("roc_monotone"),
        (F.sum("out") == 0).alias("roc_bounded"))
    arc_ok = arc.groupBy(*keys).agg(
        (F.count_if((F.col("accuracy") < 0) | (F.col("accuracy") > 1)) == 0).alias("arc_valid"))
    return (bundle.join(roc_ok, keys).join(arc_ok, keys).select(
        *keys, (tn + fp + fn + tp == F.col("n")).alias("matrix_sums"),
        *[(F.abs(F.col(m) - again[m]) < 1e-12).alias(f"{m}_ok") for m in ("accuracy", "precision", "recall")],
        "roc_monotone", "roc_bounded",
        (F.col("auroc").isNull() | F.col("auroc").between(0, 1)).alias("auroc_in_range"), "arc_valid"))
