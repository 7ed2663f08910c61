"""Tests of statistics against closed forms, and of the model jobs."""

import json
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.config import BoosterSpec
from riskloom.functions import distributions as D
from riskloom.operators import metrics, modeling, stats
from riskloom.plans import pipeline
from riskloom.session import materialize


@pytest.mark.parametrize("t, dof, p", [
    (2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (12.706205, 1, 0.05), (3.169273, 10, 0.01), (0.0, 5, 1.0)])
def test_t_tail(t, dof, p):
    assert D.t_two_sided(t, dof) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("t", [0.5, 1.96, 5.0, 12.0])
@pytest.mark.parametrize("dof", [1e10, 1e12])
def test_t_tail_of_very_many_rows_is_normal(t, dof):
    assert D.t_two_sided(t, dof) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6)


@pytest.mark.parametrize("t", [0.3, 1.0, 1.96, 4.0, 9.0])
def test_t_tail_forms_meet(t):
    dof = D.NORMAL_DOF
    assert D.t_two_sided(t, dof) == pytest.approx(D.beta_inc(dof / 2, 0.5, dof / (dof + t * t)), rel=1e-6, abs=1e-10)


@pytest.mark.parametrize("x, dof, p", [(3.841459, 1, 0.05), (9.487729, 4, 0.05), (13.276704, 4, 0.01), (0.0, 3, 1.0)])
def test_chi2_tail(x, dof, p):
    assert D.gamma_q(dof / 2, x / 2) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("x", [0.1, 1.0, 4.0, 30.0, 300.0])
def test_chi2_tail_closed_form(x):
    assert D.gamma_q(2.0, x / 2) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 600
    y = (rng.random(n) < 0.35).astype(int)
    a = y * 1.5 + rng.normal(size=n)
    b = np.round(rng.normal(size=n), 1)
    c = rng.normal(size=n) - 0.4 * y
    dom = np.array(["Math", "IS", "Finance"])[rng.integers(3, size=n)]
    rows = [(i, int(y[i]), float(a[i]), float(b[i]), float(c[i]), str(dom[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, hallucination_label int, a double, b double, c double, domain string").cache()
    return df, y, {"a": a, "b": b, "c": c}, dom


def _ranks(x):
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def test_correlations(table):
    df, y, cols, _ = table
    got = {r.feature: r for r in stats.correlation_test(df, list(cols), "hallucination_label").collect()}
    for name, x in cols.items():
        assert got[name].pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert got[name].spearman_r == pytest.approx(np.corrcoef(_ranks(x), _ranks(y))[0, 1])
        assert got[name].pointbiserial_r == got[name].pearson_r
    assert got["a"].significant_001 and not got["b"].significant_001
    with pytest.raises(ValueError):
        stats.feature_correlations(df, ["a"], "hallucination_label", "kendall")


def test_correlation_skips_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (0, None), (1, float("nan")), (0, 0.0), (1, 2.0)], "y int, x double")
    row = stats.pearson(df, ["x"], "y").first()
    assert row.n == 3 and row.r == pytest.approx(np.corrcoef([1, 0, 2], [1, 0, 1])[0, 1])


def test_chi_square_and_pairs(table):
    df, y, _, dom = table
    want = 0.0
    for d in set(dom):
        for k in (0, 1):
            e = (dom == d).sum() * (y == k).sum() / len(y)
            want += (((dom == d) & (y == k)).sum() - e) ** 2 / e
    row = stats.chi_square(df, "hallucination_label").first()
    assert row.chi_square == pytest.approx(want) and row.dof == 2 and row.p_value == pytest.approx(math.exp(-want / 2))
    always = stats.pairwise_proportions(df, "hallucination_label", always=True).collect()
    assert [(r.domain1, r.domain2) for r in sorted(always)] == [("Finance", "IS"), ("Finance", "Math"), ("IS", "Math")]
    gated = stats.pairwise_proportions(df, "hallucination_label").count()
    assert gated == (3 if row.significant else 0)


def test_yates(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 25 + [("b", 0)] * 15
    df = spark.createDataFrame(rows, "domain string, y int")
    got = stats.chi_square(df, "y").first()
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in [(10, 15), (20, 15), (25, 20), (15, 20)])
    assert got.dof == 1 and got.chi_square == pytest.approx(want)


def test_terciles_with_equal_edges(spark):
    rows = [(1, 0.5, 1)] * 8 + [(0, 0.9, 2)] + [(1, 0.1, 0)]
    df = spark.createDataFrame(rows, "y int, avg_entity_rarity double, num_entities int")
    got = {r.rarity_group: r.n for r in stats.rarity_terciles(df, "y").collect()}
    assert got == {"Low Rarity (Popular)": 8, "High Rarity (Rare)": 1}


def test_importance_variation(spark):
    rows = [("d1", "f", 0.1), ("d2", "f", 0.3), ("d1", "g", 0.2), ("d1", "h", 0.2), ("d2", "h", 0.2)]
    df = spark.createDataFrame(rows, "domain string, feature string, importance double")
    got = stats.importance_variation(df).collect()
    assert [r.feature for r in got] == ["f", "h"]
    assert got[0].coefficient_variation == pytest.approx(0.5) and got[0].varies_across_domains and not got[1].varies_across_domains
    grid = stats.importance_by_domain(df, ["d1", "d2"], top=1).collect()
    assert len(grid) == 1 and grid[0].row_mean == pytest.approx(0.2)


SPEC = BoosterSpec(n_trees=8, step_size=0.3, gamma=0.0)


@pytest.fixture(scope="module")
def model(table):
    return modeling.train(table[0], ["a", "b", "c"], ["id"], spec=SPEC)


def test_training_learns(table, model):
    scored = modeling.scored_set(model, table[0], "m")
    row = metrics.metrics_bundle(scored).first()
    assert row.auroc > 0.8 and row.n == 600
    assert scored.filter("p < 0 or p > 1 or (p >= 0.5) != (pred = 1)").count() == 0


def test_save_and_load(spark, table, model, tmp_path):
    model.save(str(tmp_path / "m"))
    back = modeling.load_model(spark, str(tmp_path / "m"))
    assert back.columns == model.columns and back.spec == model.spec
    one = {r.id: r.p for r in model.predict(table[0]).collect()}
    assert one == {r.id: r.p for r in back.predict(table[0]).collect()}


def test_permutation_importance(table, model):
    got = {r.feature: r.importance for r in modeling.permutation_importance(model, table[0], ["id"], rows_per_block=128).collect()}
    assert set(got) == {"a", "b", "c"} and max(got, key=got.get) == "a" and got["a"] > 0.1


def test_calibration_does_not_hurt_the_fit_set(table, model):
    scored = modeling.scored_set(model, table[0], "m").cache()
    base = metrics.metrics_bundle(scored).first()
    iso = modeling.calibrate_isotonic(scored, scored)
    assert metrics.metrics_bundle(iso).first().ece <= base.ece + 1e-9
    pairs = sorted((a.p, b.p) for a, b in zip(scored.collect(), iso.collect()))
    assert all(x[1] <= y[1] + 1e-12 for x, y in zip(pairs, pairs[1:]))
    platt = metrics.metrics_bundle(modeling.calibrate_platt(scored, scored)).first()
    assert platt.auroc == pytest.approx(base.auroc) and platt.brier <= base.brier + 1e-3


def test_trial_specs_stay_in_range():
    specs = modeling.trial_specs(50)
    assert specs == modeling.trial_specs(50) and len(set(map(str, specs))) == 50
    for s in specs:
        for name, (lo, hi) in s.ranges.items():
            assert lo <= getattr(s, name) <= hi


def test_ablation_ignores_missing_and_empty(table):
    got = modeling.ablation(table[0], {"both": ["a", "gone"], "noise": ["b"], "none": ["gone"]}, ["id"], spec=SPEC).collect()
    assert [r.model for r in got] == ["both", "noise"] and [r.n_features for r in got] == [1, 1]


def test_domain_models_need_rows(table):
    few = table[0].filter((F.col("domain") != "IS") | (F.col("id") < 60))
    fits = modeling.domain_models(few, ["a", "b", "domain_IS"], ["id"], spec=SPEC, min_rows=100)
    assert set(fits.models) == {"Math", "Finance"} and fits.models["Math"].columns == ["a", "b"]
    assert {r.domain: r.fit for r in fits.plan.collect()} == {"Math": "stratified", "Finance": "stratified", "IS": "too few rows"}
    by = {r.domain: r for r in metrics.metrics_bundle(fits.scored).collect()}
    sizes = {(r.domain, r.hallucination_label): r["count"] for r in few.groupBy("domain", "hallucination_label").count().collect()}
    for d in ("Math", "Finance"):
        n = [sizes[d, k] - round(.8 * sizes[d, k]) for k in (0, 1)]
        assert by[d].n == sum(n) and by[d].tp + by[d].fn == n[1]
    assert {r.domain for r in fits.importance(few.sparkSession).collect()} == {"Math", "Finance"}


def test_domains_without_a_model_say_why(spark):
    rows = [("rare", i, float(i), int(i == 7)) for i in range(60)] + [("one", 100 + i, 0.0, 1) for i in range(60)]
    rows += [("few", 200, 1.0, 0), (None, 201, 1.0, 1)]
    df = spark.createDataFrame(rows, "domain string, id long, a double, hallucination_label int")
    fits = modeling.domain_models(df, ["a"], ["id"], spec=SPEC)
    assert {(r.domain, r.n_rows, r.n_least, r.fit) for r in fits.plan.collect()} == {
        ("rare", 60, 1, "random"), ("one", 60, 0, "one class"), ("few", 1, 0, "too few rows"), (None, 1, 0, "too few rows")}
    assert set(fits.models) == {"rare"} and fits.scored.count() == 12
    none = modeling.domain_models(df.filter("domain = 'few'"), ["a"], ["id"], spec=SPEC)
    assert not none.models and none.scored is None and none.importance(spark) is None


def test_a_stored_matrix_fits_as_the_rows_do(table):
    """Weights and validation rows of a group are those that the group alone would have."""
    df = table[0]
    stored = modeling.training_matrix(df, ["a", "b"], ["id"], "hallucination_label", SPEC, "domain")
    for d in ("Math", "IS"):
        own = df.filter(F.col("domain") == d)
        alone = modeling.training_frame(own, ["a", "b"], ["id"], "hallucination_label", SPEC)
        look = lambda f: sorted((r.id, r.is_validation, round(r.weight, 9)) for r in f.select("id", "is_validation", "weight").collect())
        assert look(stored.filter(F.col("domain") == d)) == look(alone)
        assert {r.is_validation for r in alone.collect()} == {True, False}


def test_tuning_scores_each_fold_with_its_own_weights(table):
    base = BoosterSpec(ranges={**BoosterSpec().ranges, "n_trees": (3, 5), "max_depth": (2, 3)})
    best, scores = modeling.tune(table[0], ["a", "b"], ["id"], n_trials=2, base=base)
    assert len(scores) == 2 and all(.7 < s <= 1 for s in scores) and best == modeling.trial_specs(2, base)[scores.index(max(scores))]


def test_research_questions(table):
    names = {"a": "semantic_entropy", "b": "naive_max_prob", "c": "avg_entity_rarity"}
    df = table[0].select(F.col("id").alias("prompt_id"), "domain", "hallucination_label", *[F.col(k).alias(v) for k, v in names.items()],
                         (F.col("id") % 3).cast("int").alias("num_entities"))
    out = pipeline.research_questions(df, spec=SPEC, min_rows=100)
    got = {r.model: r.n_features for r in out.ablation.collect()}
    assert got == {"Baseline: Naive Confidence": 1, "Semantic Uncertainty": 1, "Context Only": 1, "Semantic + Context": 2, "Full Model": 4}
    assert out.semantic_vs_naive.first().supported and out.domain_metrics.count() == 3
    assert {r.feature for r in out.importance_variation.collect()} == {*names.values(), "num_entities"}
    assert {r.fit for r in out.domain_plan.collect()} == {"stratified"} and out.rates.count() == 3
    assert sum(r.n for r in out.terciles.collect()) == df.filter("num_entities > 0").count()
    document = json.loads(out.document.first().document)
    assert len(document["ablation_study"]) == 5 and len(document["top_correlated_features"]) == 4


def test_tasks_of_a_fit_follow_its_rows(spark, monkeypatch):
    rows = spark.range(600).repartition(16).selectExpr("id % 2 AS y", "id * 1.0 AS x", "id % 3 = 0 AS is_validation", "1.0 AS weight", "id % 4 AS part")
    stored, tasks = materialize(rows, "many-files"), []
    monkeypatch.setattr(modeling, "booster", lambda *_: SimpleNamespace(fit=lambda ready: tasks.append((ready.count(), ready.rdd.getNumPartitions()))))
    jobs = {"all": (None, ["x"]), "one": (F.col("part") == 1, ["x"])}
    modeling.fit_many(stored, jobs, "y", parallelism=1)
    monkeypatch.setattr(modeling, "ROWS_PER_TASK", 200)
    modeling.fit_many(stored, jobs, "y", parallelism=1)
    assert stored.rdd.getNumPartitions() > 3 and tasks == [(600, 1), (150, 1), (600, 3), (150, 1)]
