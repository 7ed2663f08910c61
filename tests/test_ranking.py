"""Order statistics against plain Python, on skewed data too."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ranking, splits


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        x = rng.choice([0.5, 1 - 10 ** -rng.uniform(3, 12), rng.random(), 10 ** -rng.uniform(3, 12)])
        rows.append((i, key, x))
    return rows, spark.createDataFrame(rows, "id long, k string, x double")


def test_running_totals(skewed):
    rows, df = skewed
    cells = df.groupBy("k", "x").agg(F.count("*").alias("n"))
    got = {(r.k, r.x): (r.cum_n, r.total_n) for r in ranking.running_totals(cells, ["k"], [F.col("x")], {"n": F.col("n")}).collect()}
    for key in {r[1] for r in rows}:
        xs = sorted(r[2] for r in rows if r[1] == key)
        for x in set(xs):
            assert got[(key, x)] == (sum(v <= x for v in xs), len(xs))


@pytest.fixture
def small_runs(monkeypatch):
    """Groups of over 100 rows are cut."""
    monkeypatch.setattr(ranking, "ROWS", 100)


def largest_run(df, keys, order):
    cut, was_cut = ranking.cut_order(df, keys, order)
    assert was_cut
    return cut.groupBy(*keys, "_run").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("values", ["one key", "tiny and infinite", "all equal", "no key"])
def test_largest_run_is_bounded(spark, small_runs, values):
    """Whatever the distribution, no task sorts much more than the bound: one key with all rows, values from 1e-300
    to infinity, one value in all rows."""
    x = {"one key": "id / 3", "tiny and infinite": "CASE WHEN id = 7 THEN double('inf') WHEN id % 2 = 0 THEN pow(10, -id / 20) ELSE id * 1e-9 END",
         "all equal": "0.5", "no key": "-id * id"}[values]
    df = spark.range(5000).selectExpr("'hot' AS k", "id", f"cast({x} AS double) AS x").repartition(6)
    keys = [] if values == "no key" else ["k"]
    assert largest_run(df, keys, [F.col("x")]) <= 200
    rows = [(r.x, r.position) for r in ranking.positions(df, keys, [F.col("x")]).collect()]
    assert sorted(p for _, p in rows) == list(range(5000))
    assert [x for x, _ in sorted(rows, key=lambda r: r[1])] == sorted(x for x, _ in rows)


def test_cut_groups_give_the_same_results(skewed, small_runs):
    """The tests of this file with every group of over 100 rows cut, null keys among them."""
    test_running_totals(skewed)
    test_positions(skewed)
    for shift, scale in [(0, 1), (1000, 1e-3), (-5, 1e6)]:
        test_exact_quantiles(skewed, shift, scale)
    test_hash_cut_takes_exactly_the_quota(skewed)
    _, df = skewed
    nulls = df.withColumn("k", F.when(F.col("k") == "hot", F.lit(None)).otherwise(F.col("k")))
    got = {r.id: r.position for r in ranking.positions(nulls, ["k"], [F.col("id")]).collect()}
    hot = sorted(r.id for r in nulls.filter("k IS NULL").collect())
    assert [got[i] for i in hot] == list(range(len(hot))) and len(got) == 4000


def test_hash_cut_refines_a_full_bucket(spark, monkeypatch):
    """With one digit a step, the cut is found after several histograms and is the same."""
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("hallucination_label"))
    want = {r.id: r.split for r in splits.stratified_split(df, ["id"]).collect()}
    monkeypatch.setattr(ranking, "DIGITS", 1)
    monkeypatch.setattr(ranking, "ROWS", 3)
    assert {r.id: r.split for r in splits.stratified_split(df, ["id"]).collect()} == want


def test_positions(skewed):
    rows, df = skewed
    got = {r.id: r.position for r in ranking.positions(df, ["k"], [F.col("id")]).collect()}
    for key in {r[1] for r in rows}:
        for want, i in enumerate(sorted(r[0] for r in rows if r[1] == key)):
            assert got[i] == want


@pytest.mark.parametrize("shift, scale", [(0, 1), (1000, 1e-3), (-5, 1e6)])
def test_exact_quantiles(skewed, shift, scale):
    rows, df = skewed
    moved = df.select("k", (F.col("x") * scale + shift).alias("x"))
    got = {(r.k, r.q): r.at for r in ranking.exact_quantiles(moved, ["k"], [0.0, 1 / 3, 0.5, 0.9, 1.0]).collect()}
    for key in {r[1] for r in rows}:
        xs = np.array([r[2] for r in rows if r[1] == key]) * scale + shift
        for q in (0.0, 1 / 3, 0.5, 0.9, 1.0):
            assert got[(key, q)] == pytest.approx(np.quantile(xs, q), rel=1e-12)


def test_hash_cut_takes_exactly_the_quota(skewed):
    rows, df = skewed
    out = splits.stratified_split(df.withColumnRenamed("k", "hallucination_label"), ["id"])
    got = {r.id: r.split for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == key), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
        n = round(0.8 * len(ids))
        assert all(got[i] == "train" for i in ids[:n]) and all(got[i] == "test" for i in ids[n:])


def test_split_counts(spark):
    df = spark.range(500).select("id", (F.col("id") < 125).cast("int").alias("hallucination_label"))
    out = splits.stratified_split(df, ["id"], check=True)
    got = {(r.split, r.hallucination_label): r["count"] for r in out.groupBy("split", "hallucination_label").count().collect()}
    assert got == {("train", 1): 100, ("train", 0): 300, ("test", 1): 25, ("test", 0): 75}
    with pytest.raises(ValueError):
        splits.stratified_split(df.filter("id < 125"), ["id"], check=True)


def test_sample_limit(spark):
    df = spark.range(1000)
    a = {r.id for r in splits.sample_limit(df, ["id"], 137).collect()}
    b = {r.id for r in splits.sample_limit(df.repartition(7), ["id"], 137).collect()}
    assert len(a) == 137 and a == b
    assert splits.sample_limit(df, ["id"], 5000).count() == 1000


@pytest.mark.parametrize("n, k", [(35, 3), (12, 2), (100, 5)])
def test_folds(spark, n, k):
    df = spark.range(n).select("id", (F.col("id") % 3 == 0).cast("int").alias("hallucination_label"))
    rows = splits.stratified_folds(df, ["id"]).collect()
    assert len(rows) == n and {r.fold for r in rows} == set(range(k))
    for y in (0, 1):
        sizes = [sum(r.fold == f and r.hallucination_label == y for r in rows) for f in range(k)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_join_back_to_wide_rows(spark, small_runs):
    df = spark.range(400).select((F.col("id") / 2).cast("long").alias("id"), (F.col("id") % 2).cast("int").alias("hallucination_label"),
                                 F.concat(F.lit("t"), "id").alias("text"))
    wide = splits.stratified_folds(df, ["id"]).collect()
    narrow = {(r.id, r.hallucination_label): r.fold for r in splits.stratified_folds(df.drop("text"), ["id"]).collect()}
    assert len(wide) == 400 and all(narrow[r.id, r.hallucination_label] == r.fold for r in wide)


def test_validation_needs_enough_rows(spark):
    small = spark.range(20).select("id", (F.col("id") % 2).cast("int").alias("hallucination_label"))
    assert splits.validation_split(small, ["id"]).filter("is_validation").count() == 0
    large = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("hallucination_label"))
    assert splits.validation_split(large, ["id"]).filter("is_validation").count() == 20
