"""Metrics (survey section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.plans.registry import query
from riskloom.plans.views import Views

K = M.KEYS


def all_scored(v: Views):
    cols = ["model", "domain", "y", "p", "pred"]
    return v.scored_big.select(*cols).unionByName(v.scored.select(*cols))


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query("confusion_matrix", """
    SELECT model, domain,
      count(*) FILTER (WHERE y=0 AND pred=0) AS tn, count(*) FILTER (WHERE y=0 AND pred=1) AS fp,
      count(*) FILTER (WHERE y=1 AND pred=0) AS fn, count(*) FILTER (WHERE y=1 AND pred=1) AS tp
    FROM v_all_scored GROUP BY ALL""", ("v_all_scored",))
def confusion_matrix(v):
    return M.confusion_matrix(all_scored(v))


_CM = """cm AS (
    SELECT model, domain, CAST(count(*) AS DOUBLE) AS n,
      CAST(count(*) FILTER (WHERE y=0 AND pred=0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y=0 AND pred=1) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (WHERE y=1 AND pred=0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y=1 AND pred=1) AS DOUBLE) AS tp
    FROM v_all_scored GROUP BY ALL)"""
_RATES = """round((tp+tn)/n, 6) AS accuracy,
      round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0 END, 6) AS precision,
      round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0 END, 6) AS recall,
      round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END, 6) AS f1,
      round(CASE WHEN tn+fp>0 THEN tn/(tn+fp) ELSE 0.0 END, 6) AS specificity"""
_AUC = """ranked AS (
    SELECT model, domain, y, rank() OVER (PARTITION BY model, domain ORDER BY p)
         + (count(*) OVER (PARTITION BY model, domain, p) - 1) / 2.0 AS r FROM v_all_scored),
  auc AS (
    SELECT model, domain, CASE WHEN sum(y) > 0 AND sum(1-y) > 0 THEN
      (sum(r) FILTER (WHERE y=1) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1-y)) END AS auroc
    FROM ranked GROUP BY ALL)"""
_ARC = """ordered AS (
    SELECT model, domain, CAST((p >= 0.5) = (y = 1) AS INTEGER) AS ok,
      row_number() OVER (PARTITION BY model, domain ORDER BY abs(p-0.5) DESC, p, y) AS rn,
      count(*) OVER (PARTITION BY model, domain) AS n FROM v_all_scored),
  prefix AS (
    SELECT model, domain, rn, n, sum(ok) OVER (PARTITION BY model, domain ORDER BY rn) AS good FROM ordered),
  sizes AS (SELECT model, domain, count(*) AS n FROM v_all_scored GROUP BY ALL),
  arc_grid AS (
    SELECT model, domain, k, k * (CAST(0.5 AS DOUBLE) / 19) AS rejection_rate,
      CAST(floor(n * (1.0 - k * (CAST(0.5 AS DOUBLE) / 19))) AS BIGINT) AS n_keep
    FROM sizes, (SELECT unnest(range(20)) AS k)),
  arc AS (
    SELECT g.model, g.domain, CAST(g.k AS INTEGER) AS k, g.rejection_rate, g.n_keep, p.good / g.n_keep AS accuracy
    FROM arc_grid g LEFT JOIN prefix p ON p.model=g.model AND p.domain=g.domain AND p.rn=g.n_keep),
  area AS (
    SELECT model, domain, CASE WHEN count(accuracy) = 20 THEN
      sum(accuracy * (CAST(0.5 AS DOUBLE) / 19) * CASE WHEN k IN (0, 19) THEN 0.5 ELSE 1.0 END) END AS auc_arc
    FROM arc GROUP BY ALL)"""
_BINS = """edges AS (SELECT CAST(i AS INTEGER) AS bin, i * CAST(0.1 AS DOUBLE) AS lo, (i + 1) * CAST(0.1 AS DOUBLE) AS hi
    FROM (SELECT unnest(range(10)) AS i)),
  keyset AS (SELECT DISTINCT model, domain FROM v_all_scored),
  bins AS (
    SELECT k.model, k.domain, e.bin, e.lo, e.hi, avg(s.y) AS acc,
      coalesce(avg(s.p), (e.lo + e.hi) / 2) AS conf, count(s.p) AS n
    FROM keyset k CROSS JOIN edges e
    LEFT JOIN v_all_scored s ON s.model=k.model AND s.domain=k.domain AND s.p > e.lo AND s.p <= e.hi
    GROUP BY k.model, k.domain, e.bin, e.lo, e.hi),
  gaps AS (
    SELECT b.model, b.domain, sum(CASE WHEN b.n > 0 THEN b.n * abs(b.acc - b.conf) ELSE 0 END) / any_value(t.n) AS ece
    FROM bins b JOIN (SELECT model, domain, count(*) AS n FROM v_all_scored GROUP BY ALL) t
      ON t.model=b.model AND t.domain=b.domain GROUP BY b.model, b.domain)"""


@query("class_metrics", f"""WITH {_CM}
    SELECT model, domain, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
           CAST(tp AS BIGINT) AS tp, {_RATES} FROM cm""", ("v_all_scored",))
def class_metrics(v):
    out = M.class_metrics(M.confusion_matrix(all_scored(v)))
    return out.select(*K, "tn", "fp", "fn", "tp", *r6("accuracy", "precision", "recall", "f1", "specificity"))


_ROC = """cells AS (
      SELECT model, domain, p, sum(y) AS pos, sum(1-y) AS neg FROM v_all_scored GROUP BY ALL),
    cum AS (
      SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
        sum(pos) OVER (PARTITION BY model, domain) AS np, sum(neg) OVER (PARTITION BY model, domain) AS nn,
        lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2, row_number() OVER w AS rn
      FROM cells WINDOW w AS (PARTITION BY model, domain ORDER BY p DESC)),
    kept AS (
      SELECT model, domain, p, CASE WHEN nn > 0 THEN fp / nn END AS fpr, CASE WHEN np > 0 THEN tp / np END AS tpr FROM cum
      WHERE rn = 1 OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg),
    roc AS (
      SELECT model, domain, row_number() OVER (PARTITION BY model, domain ORDER BY p DESC) AS k,
        fpr, tpr, p AS threshold FROM kept
      UNION ALL SELECT DISTINCT model, domain, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE) FROM cells)"""


@query("roc_curve", f"""WITH {_ROC} SELECT model, domain, k, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, threshold
    FROM roc""", ("v_all_scored",))
def roc_curve(v):
    return M.roc_curve(M.score_cells(all_scored(v))).select(*K, "k", *r6("fpr", "tpr"), "threshold")


@query("auroc", f"WITH {_AUC} SELECT model, domain, round(auroc, 6) AS auroc FROM auc", ("v_all_scored",))
def auroc(v):
    return M.auroc(M.score_cells(all_scored(v))).select(*K, *r6("auroc"))


@query("arc_curve", f"""WITH {_ARC} SELECT model, domain, k, round(rejection_rate, 6) AS rejection_rate, n_keep,
    round(accuracy, 6) AS accuracy FROM arc""", ("v_all_scored",))
def arc_curve(v):
    return M.arc_curve(M.score_cells(all_scored(v))).select(*K, "k", *r6("rejection_rate"), "n_keep", *r6("accuracy"))


@query("arc_area", f"WITH {_ARC} SELECT model, domain, round(auc_arc, 6) AS auc_arc FROM area", ("v_all_scored",))
def arc_area(v):
    return M.arc_area(M.arc_curve(M.score_cells(all_scored(v)))).select(*K, *r6("auc_arc"))


@query("calibration_bins", f"""WITH {_BINS} SELECT model, domain, bin, round(lo, 6) AS lo, round(hi, 6) AS hi,
    round(acc, 6) AS acc, round(conf, 6) AS conf, n FROM bins""", ("v_all_scored",))
def calibration_bins(v):
    return M.calibration_bins(M.score_cells(all_scored(v))).select(*K, "bin", *r6("lo", "hi", "acc", "conf"), "n")


@query("ece", f"WITH {_BINS} SELECT model, domain, round(ece, 6) AS ece FROM gaps", ("v_all_scored",))
def ece(v):
    return M.ece(M.score_cells(all_scored(v))).select(*K, *r6("ece"))


@query("brier", "SELECT model, domain, round(avg(pow(p - y, 2)), 6) AS brier FROM v_all_scored GROUP BY ALL",
       ("v_all_scored",))
def brier(v):
    return M.brier(M.score_cells(all_scored(v))).select(*K, *r6("brier"))


_BUNDLE = f"""{_CM}, {_AUC}, {_ARC}, {_BINS},
  bri AS (SELECT model, domain, avg(pow(p - y, 2)) AS brier FROM v_all_scored GROUP BY ALL),
  bundle AS (
    SELECT model, domain, CAST(n AS BIGINT) AS n, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
      CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, {_RATES}, round(ece, 6) AS ece, round(brier, 6) AS brier,
      round(auroc, 6) AS auroc, round(auc_arc, 6) AS auc_arc
    FROM cm JOIN auc USING (model, domain) JOIN area USING (model, domain)
    JOIN gaps USING (model, domain) JOIN bri USING (model, domain))"""
_BUNDLE_DOUBLES = ("accuracy", "precision", "recall", "f1", "specificity", "ece", "brier", "auroc", "auc_arc")


@query("metrics_bundle", f"WITH {_BUNDLE} SELECT * FROM bundle", ("v_all_scored",))
def metrics_bundle(v):
    out = M.metrics_bundle(all_scored(v))
    return out.select(*K, "n", "tn", "fp", "fn", "tp", *r6(*_BUNDLE_DOUBLES))


@query("compare_models", f"""WITH {_BUNDLE}
    SELECT model, domain, auroc, auc_arc, ece, accuracy, precision, recall, f1 FROM bundle""", ("v_all_scored",))
def compare_models(v):
    out = M.compare_models(M.metrics_bundle(all_scored(v)))
    return out.select(*K, *r6("auroc", "auc_arc", "ece", "accuracy", "precision", "recall", "f1"))


@query("threshold_sweep", """WITH grid AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5]::DOUBLE[]) AS threshold),
    cm AS (
      SELECT model, domain, threshold, CAST(count(*) AS DOUBLE) AS n,
        CAST(count(*) FILTER (WHERE y=0 AND p<threshold) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y=0 AND p>=threshold) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE y=1 AND p<threshold) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y=1 AND p>=threshold) AS DOUBLE) AS tp
      FROM v_all_scored, grid GROUP BY ALL),
    m AS (SELECT *, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS f FROM cm)
    SELECT model, domain, threshold, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
      CAST(tp AS BIGINT) AS tp, """ + _RATES + """,
      row_number() OVER (PARTITION BY model, domain ORDER BY f DESC, threshold) = 1 AS best FROM m""", ("v_all_scored",))
def threshold_sweep(v):
    out = M.threshold_sweep(M.score_cells(all_scored(v)))
    return out.select(*K, "threshold", "tn", "fp", "fn", "tp",
                      *r6("accuracy", "precision", "recall", "f1", "specificity"), "best")


@query("metrics_integrity", f"""WITH {_BUNDLE}, {_ROC},
    steps AS (SELECT *, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM roc
              WINDOW w AS (PARTITION BY model, domain ORDER BY k)),
    shape AS (SELECT model, domain, count(*) FILTER (WHERE fpr < f0 OR tpr < t0) = 0 AS roc_monotone,
                count(*) FILTER (WHERE fpr < 0 OR fpr > 1 OR tpr < 0 OR tpr > 1) = 0 AS roc_bounded
              FROM steps GROUP BY ALL),
    arc_ok AS (SELECT model, domain, count(*) FILTER (WHERE accuracy < 0 OR accuracy > 1) = 0 AS arc_valid FROM arc GROUP BY ALL)
    SELECT model, domain, b.tn + b.fp + b.fn + b.tp = b.n AS matrix_sums,
      abs(b.accuracy - (b.tp + b.tn) / b.n) < 1e-5 AS accuracy_ok,
      abs(b.precision - coalesce(b.tp / nullif(b.tp + b.fp, 0), 0)) < 1e-5 AS precision_ok,
      abs(b.recall - coalesce(b.tp / nullif(b.tp + b.fn, 0), 0)) < 1e-5 AS recall_ok,
      roc_monotone, roc_bounded, b.auroc IS NULL OR b.auroc BETWEEN 0 AND 1 AS auroc_in_range, arc_valid
    FROM bundle b JOIN shape USING (model, domain) JOIN arc_ok USING (model, domain)""", ("v_all_scored",))
def metrics_integrity(v):
    cells = M.stored_cells(all_scored(v))
    return M.integrity(M.bundle_of_cells(cells), M.roc_curve(cells), M.arc_curve(cells))


@query("domain_metrics_table", f"""WITH {_BUNDLE}
    SELECT model, domain, auroc, accuracy, precision, recall, f1, n FROM bundle""", ("v_all_scored",))
def domain_metrics_table(v):
    return M.metrics_bundle(all_scored(v)).select(
        *K, *r6("auroc", "accuracy", "precision", "recall", "f1"), "n")
