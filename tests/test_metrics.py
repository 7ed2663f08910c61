"""Metrics: published numbers, brute force and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics as M

# Published confusion counts and the metrics that go with them.
GOLDEN = {
    "math": ((66, 7, 15, 20), (0.796296, 0.740741, 0.571429, 0.645161, 0.904110)),
    "is_agents": ((8, 4, 27, 61), (0.690000, 0.938462, 0.693182, 0.797386, 0.666667)),
    "psychology": ((29, 46, 4, 21), (0.500000, 0.313433, 0.840000, 0.456522, 0.386667)),
    "medicine": ((28, 22, 14, 36), (0.640000, 0.620690, 0.720000, 0.666667, 0.560000)),
    "finance": ((16, 10, 26, 48), (0.640000, 0.827586, 0.648649, 0.727273, 0.615385)),
}
# Published calibration bins of one set (count, accuracy, confidence) and its error.
BINS = [(3, 7, 0.285714, 0.269255), (4, 36, 0.138889, 0.351791), (5, 38, 0.210526, 0.454476), (6, 1, 0.0, 0.590043),
        (8, 21, 0.809524, 0.759081), (9, 5, 0.6, 0.827872)]
ECE_MATH = 0.183690
# A published accuracy-rejection curve and its area.
ARC = [0.69, 0.701031, 0.702128, 0.717391, 0.707865, 0.732558, 0.72619, 0.716049, 0.730769, 0.723684,
       0.726027, 0.746479, 0.75, 0.769231, 0.761905, 0.783333, 0.807018, 0.8, 0.826923, 0.82]
ARC_AREA = 0.373252
# A published ROC curve and its area.
FPR = [0, 0, 0, 0, 0, 0, 0, 0.0833333, 0.0833333, 0.166667, 0.166667, 0.25, 0.25, 0.25, 0.25, 0.333333, 0.333333, 0.333333,
       0.333333, 0.416667, 0.416667, 0.5, 0.5, 0.583333, 0.583333, 0.75, 0.75, 0.833333, 0.833333, 0.916667, 0.916667, 1]
TPR = [0, 0.0113636, 0.0454545, 0.0795455, 0.193182, 0.215909, 0.306818, 0.306818, 0.340909, 0.340909, 0.534091, 0.534091,
       0.590909, 0.625, 0.670455, 0.670455, 0.715909, 0.761364, 0.772727, 0.772727, 0.795455, 0.795455, 0.852273, 0.852273,
       0.920455, 0.920455, 0.931818, 0.931818, 0.943182, 0.943182, 1, 1]
AUROC = 0.749053
# Published counts per threshold; the best F1 is at 0.5.
SWEEP = {0.3: (10, 65, 0, 25), 0.35: (12, 63, 1, 24), 0.4: (17, 58, 4, 21), 0.45: (23, 52, 4, 21), 0.5: (29, 46, 4, 21)}


def frame(spark, rows):
    return spark.createDataFrame([("m", "d", y, float(p), int(p >= 0.5)) for y, p in rows],
                                 "model string, domain string, y int, p double, pred int")


@pytest.fixture(scope="module")
def random_set(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), round(rng.random(), rng.choice([1, 2, 6]))) for _ in range(700)] + [(1, 0.0), (0, 1.0)]
    return rows, frame(spark, rows)


def test_golden_class_metrics(spark):
    df = spark.createDataFrame([(k, *v[0]) for k, v in GOLDEN.items()], "model string, tn long, fp long, fn long, tp long")
    for r in M.class_metrics(df).collect():
        got = (r.accuracy, r.precision, r.recall, r.f1, r.specificity)
        assert got == pytest.approx(GOLDEN[r.model][1], abs=1e-6)


def test_golden_ece(spark):
    rows = []
    for b, n, acc, conf in BINS:
        hits = round(acc * n)
        rows += [(1, conf)] * hits + [(0, conf)] * (n - hits)
    cells = M.score_cells(frame(spark, rows))
    assert M.ece(cells).first().ece == pytest.approx(ECE_MATH, abs=2e-6)
    bins = {r.bin: r for r in M.calibration_bins(cells).collect()}
    assert len(bins) == 10 and bins[0].n == 0 and bins[0].acc is None and bins[0].conf == pytest.approx(0.05)
    assert [bins[b - 1].n for b, *_ in BINS] == [n for _, n, *_ in BINS]


def test_golden_arc_area(spark):
    curve = spark.createDataFrame([("m", "d", k, a) for k, a in enumerate(ARC)], "model string, domain string, k int, accuracy double")
    assert M.arc_area(curve).first().auc_arc == pytest.approx(ARC_AREA, abs=1e-6)


def test_golden_roc(spark):
    """A scored set with the published step sizes gives back the curve and the area."""
    rows, p = [], 0.99
    for (f0, t0), (f1, t1) in zip(zip(FPR, TPR), zip(FPR[1:], TPR[1:])):
        neg, pos = round((f1 - f0) * 12), round((t1 - t0) * 88)
        rows += [(0, p)] * neg + [(1, p)] * pos
        p -= 0.01
    cells = M.score_cells(frame(spark, rows))
    assert M.auroc(cells).first().auroc == pytest.approx(AUROC, abs=1e-5)
    curve = sorted((r.k, r.fpr, r.tpr) for r in M.roc_curve(cells, drop_collinear=False).collect())
    assert [c[1] for c in curve] == pytest.approx(FPR, abs=1e-5) and [c[2] for c in curve] == pytest.approx(TPR, abs=1e-5)


def test_golden_sweep(spark):
    rows = []
    cuts = sorted(SWEEP)
    last = (0, 0)
    for lo, t in zip([0.0, *cuts], cuts):
        tn, _, fn, _ = SWEEP[t]
        rows += [(0, (lo + t) / 2)] * (tn - last[0]) + [(1, (lo + t) / 2)] * (fn - last[1])
        last = (tn, fn)
    rows += [(0, 0.9)] * SWEEP[0.5][1] + [(1, 0.9)] * SWEEP[0.5][3]
    got = {r.threshold: r for r in M.threshold_sweep(M.score_cells(frame(spark, rows))).collect()}
    assert {t: (r.tn, r.fp, r.fn, r.tp) for t, r in got.items()} == SWEEP
    assert [t for t, r in got.items() if r.best] == [0.5]


def test_auroc_brute_force(random_set):
    rows, df = random_set
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    cells = M.score_cells(df)
    assert M.auroc(cells).first().auroc == pytest.approx(want)
    flipped = M.score_cells(df.withColumn("p", 1 - F.col("p")))
    assert M.auroc(flipped).first().auroc == pytest.approx(1 - want, abs=1e-9)


def test_arc_brute_force(random_set):
    rows, df = random_set
    order = sorted(rows, key=lambda r: (-abs(r[1] - 0.5), r[1], r[0]))
    got = {r.k: (r.n_keep, r.accuracy) for r in M.arc_curve(M.score_cells(df)).collect()}
    for k in range(20):
        keep = int(len(rows) * (1.0 - k * (0.5 / 19)))
        want = np.mean([(p >= 0.5) == (y == 1) for y, p in order[:keep]])
        assert got[k] == (keep, pytest.approx(want))


def test_roc_drop_keeps_the_area(random_set):
    _, df = random_set
    cells = M.score_cells(df)

    def area(drop):
        pts = sorted((r.k, r.fpr, r.tpr) for r in M.roc_curve(cells, drop_collinear=drop).collect())
        return len(pts), np.trapezoid([p[2] for p in pts], [p[1] for p in pts])

    (few, a), (many, b) = area(True), area(False)
    assert few < many and a == pytest.approx(b)


def test_bundle_and_integrity(random_set):
    rows, df = random_set
    cells = M.score_cells(df)
    row = M.metrics_bundle(df).first()
    assert row.n == len(rows) and 0 <= row.ece <= 1
    assert row.brier == pytest.approx(np.mean([(p - y) ** 2 for y, p in rows]))
    check = M.integrity(M.metrics_bundle(df), M.roc_curve(cells), M.arc_curve(cells)).first()
    assert all(v for k, v in check.asDict().items() if isinstance(v, bool))


def test_one_class_only(spark):
    row = M.metrics_bundle(frame(spark, [(0, 0.2), (0, 0.7), (0, 0.0)])).first()
    assert row.auroc is None and row.recall == 0.0 and row.tn == 2 and row.fp == 1


def test_zero_score_counts_in_ece_total(spark):
    row = M.ece(M.score_cells(frame(spark, [(1, 0.0), (1, 0.05)]))).first()
    assert row.ece == pytest.approx(0.5 * 0.95)
