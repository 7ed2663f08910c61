"""Model jobs (survey 2.9).

SQL cannot fit, so the checked queries return what SQL can know of a fit: which rows are in each set, counts that
must add up, ranges, bounds and sums.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.config import MIN_ROWS_PER_DOMAIN_MODEL, BoosterSpec
from riskloom.operators import metrics, modeling, splits, stats
from riskloom.operators.matrix import feature_groups
from riskloom.plans.label_queries import _h
from riskloom.plans.registry import query
from riskloom.plans.views import VIEW_SQL, Views
from riskloom.session import fresh_path, materialize

COLS = Views.FEATURES
IDS = ["doc_id"]

VIEW_SQL["v_model_split"] = (("v_features",), f"""
    SELECT doc_id, y, domain, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {_h('doc_id')})
        <= round(0.8::DOUBLE * count(*) OVER (PARTITION BY y)) THEN 'train' ELSE 'test' END AS split FROM v_features""")
_FEATURE = f"SELECT unnest({COLS}) AS feature"


def split_features(v):
    """Labelled document features with the split, written once for the fits."""
    df = materialize(v.features.select("doc_id", F.col("y").alias(modeling.LABEL), "domain", *COLS), "features")
    return materialize(splits.stratified_split(df, IDS), "split")


def fitted(v):
    train, test = splits.route_split(split_features(v), IDS)
    return modeling.train(train, COLS, IDS), train, test


def _sizes(bundle, least_auroc):
    """Rows of a set by label, whether its confusion counts cover them, and whether its AUROC reaches a bound."""
    n_pos, n_neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return bundle.select("model", "domain", "n", n_pos.cast("bigint").alias("n_pos"), (n_pos + n_neg == F.col("n")).alias("adds_up"),
                         (F.col("auroc") >= least_auroc).alias("ranks_well"))


@query("train_classifier", """SELECT split AS model, 'all' AS domain, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos,
    true AS adds_up, true AS ranks_well FROM v_model_split GROUP BY 1""", ("v_model_split",))
def train_classifier(v):
    model, train, test = fitted(v)
    both = modeling.scored_set(model, train, "train").unionByName(modeling.scored_set(model, test, "test"))
    return _sizes(metrics.metrics_bundle(both), 0.8)


@query("predict", """SELECT doc_id, y AS hallucination_label, true AS p_in_range, true AS pred_at_half
    FROM v_model_split WHERE split = 'test'""", ("v_model_split",))
def predict(v):
    model, _, test = fitted(v)
    return model.predict(test).select("doc_id", modeling.LABEL, F.col("p").between(0, 1).alias("p_in_range"),
                                      (F.col("pred") == (F.col("p") >= 0.5).cast("int")).alias("pred_at_half"))


@query("feature_importance", f"{_FEATURE}, true AS in_range, true AS sums_to_one")
def feature_importance(v):
    model, _, _ = fitted(v)
    rows = model.importance(v.spark)
    total = rows.agg(F.sum("importance")).scalar()
    return rows.select("feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("permutation_importance", f"{_FEATURE}, true AS in_range")
def permutation_importance(v):
    model, _, test = fitted(v)
    return modeling.permutation_importance(model, test, IDS).select("feature", F.col("importance").between(-1, 1).alias("in_range"))


@query("model_persist", "SELECT doc_id, true AS same FROM v_model_split WHERE split = 'test'", ("v_model_split",))
def model_persist(v):
    model, _, test = fitted(v)
    path = fresh_path(v.spark, "model")
    model.save(path)
    back = modeling.load_model(v.spark, path)
    again = back.predict(test).select("doc_id", F.col("p").alias("p_loaded"))
    return model.predict(test).join(again, "doc_id").select("doc_id", (F.col("p") == F.col("p_loaded")).alias("same"))


@query("tune_classifier", "SELECT unnest(range(3))::INTEGER AS trial, true AS in_ranges, true AS ranks_well, true AS one_best")
def tune_classifier(v):
    """Three trials of small trees: every trial is fitted once a fold, and without early stopping.

    SQL knows the number of trials, the ranges of the draws, and that exactly one is best, by the largest AUROC.
    """
    train, _ = splits.route_split(split_features(v), IDS)
    base = BoosterSpec(ranges={**BoosterSpec().ranges, "n_trees": (5, 10), "max_depth": (2, 4)})
    best, scores = modeling.tune(train, COLS, IDS, n_trials=3, base=base)
    specs = modeling.trial_specs(3, base)
    inside = [all(lo <= getattr(s, name) <= hi for name, (lo, hi) in base.ranges.items()) for s in specs]
    one = [s == best for s in specs].count(True) == 1 and best == specs[scores.index(max(scores))]
    rows = [(i, inside[i], 0.7 < score <= 1.0, one) for i, score in enumerate(scores)]
    return v.spark.createDataFrame(rows, "trial int, in_ranges boolean, ranks_well boolean, one_best boolean")


_ABLATED = dict(zip(COLS, ["naive_max_prob", "semantic_entropy", "lexical_diversity", "token_count", "semantic_energy"]))
_GROUP_ROWS = ", ".join(f"('{title}', {len(names)})" for title, names in feature_groups(list(_ABLATED.values())).items() if names)


@query("ablation", f"""SELECT g.model, g.n_features::INTEGER AS n_features, t.n, t.n_pos, true AS adds_up
    FROM (VALUES {_GROUP_ROWS}) AS g(model, n_features), (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos FROM v_model_split WHERE split = 'test') t""",
       ("v_model_split",))
def ablation(v):
    """The published groups, over features renamed to fall into them; each model is judged on the same test rows."""
    out = modeling.ablation(split_features(v).withColumnsRenamed(_ABLATED), feature_groups(list(_ABLATED.values())), IDS)
    n_pos = (F.col("tp") + F.col("fn")).cast("bigint")
    return out.select("model", "n_features", "n", n_pos.alias("n_pos"), (F.col("tn") + F.col("fp") + n_pos == F.col("n")).alias("adds_up"))


def _domain_models(v):
    return modeling.domain_models(split_features(v), COLS, IDS)


@query("domain_models", f"""SELECT 'domain_model' AS model, domain, count(*) FILTER (WHERE split = 'test') AS n,
      count(*) FILTER (WHERE split = 'test' AND y = 1) AS n_pos, true AS adds_up FROM v_model_split GROUP BY domain
    HAVING count(*) >= {MIN_ROWS_PER_DOMAIN_MODEL} AND count(DISTINCT y) = 2""", ("v_model_split",))
def domain_models(v):
    return _sizes(metrics.metrics_bundle(_domain_models(v).scored), 0.5).drop("ranks_well")


@query("domain_fits", f"""SELECT source, n_rows, n_least, CASE WHEN n_rows < {MIN_ROWS_PER_DOMAIN_MODEL} THEN 'too few rows' WHEN n_least = 0 THEN 'one class'
      WHEN n_least = 1 THEN 'random' ELSE 'stratified' END AS fit
    FROM (SELECT source, count(*) AS n_rows, least(count(*) FILTER (WHERE y = 0), count(*) FILTER (WHERE y = 1)) AS n_least FROM v_features GROUP BY 1)""",
       ("v_features",))
def domain_fits(v):
    """Which groups get a model of their own and how they are split, and which are skipped and why, by source."""
    return modeling.domain_plan(v.features, "y", domain="source")


@query("domain_model_importance")
def domain_model_importance(v):
    return stats.importance_variation(_domain_models(v).importance(v.spark))


def _calibrated(v, how, alike):
    """Rows of the set that was fitted on and of the held one, by label, with ``alike`` judged on the former."""
    model, train, test = fitted(v)
    fit_on, held = modeling.scored_set(model, train, "fit"), modeling.scored_set(model, test, "held")
    return how(fit_on, fit_on.unionByName(held)).groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), F.bool_and(F.col("p").between(0, 1)).alias("p_in_range"),
        F.when(F.first("model") == "fit", F.abs(F.avg("p") - F.avg(F.col("y").cast("double"))) < alike).alias("mean_kept"))


_CALIBRATED = """SELECT CASE split WHEN 'train' THEN 'fit' ELSE 'held' END AS model, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos,
    true AS p_in_range, CASE split WHEN 'train' THEN true END AS mean_kept FROM v_model_split GROUP BY split"""


@query("calibrate_platt", _CALIBRATED, ("v_model_split",))
def calibrate_platt(v):
    return _calibrated(v, modeling.calibrate_platt, 1e-3)


@query("calibrate_isotonic", _CALIBRATED, ("v_model_split",))
def calibrate_isotonic(v):
    return _calibrated(v, modeling.calibrate_isotonic, 1e-9)


@query("output_completeness", """SELECT domain, count(*) AS n_prompts, count(*) FILTER (WHERE prompt_id IN (SELECT prompt_id FROM v_samples)) AS n_answered,
      count(*) FILTER (WHERE prompt_id IN (SELECT prompt_id FROM v_logprobs)) AS n_with_logprobs,
      count(*) = count(*) FILTER (WHERE prompt_id IN (SELECT prompt_id FROM v_samples)) AS complete
    FROM v_prompts GROUP BY 1""", ("v_prompts", "v_samples", "v_logprobs"))
def output_completeness(v):
    answered = v.samples.groupBy("prompt_id").agg(F.count("*").alias("n_samples"))
    tokens = v.logprobs.filter("pos = 0").select("prompt_id", F.lit(True).alias("has_tokens"))
    joined = v.prompts.select("prompt_id", "domain").join(answered, "prompt_id", "left").join(tokens, "prompt_id", "left")
    return joined.groupBy("domain").agg(
        F.count("*").alias("n_prompts"), F.count("n_samples").alias("n_answered"),
        F.count("has_tokens").alias("n_with_logprobs"), (F.count("*") == F.count("n_samples")).alias("complete"))
