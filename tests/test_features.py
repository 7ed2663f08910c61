"""Uncertainty, clustering, context, matrix and selection against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.config import CONTEXT_COLUMNS, DOMAINS, METADATA_COLUMNS
from riskloom.operators import clustering, context, matrix, selection
from riskloom.operators import uncertainty as U


def test_partner_counts_with_gaps(spark):
    rows = [("a", i) for i in (0, 3, 4, 9_000)] + [("b", 7)]
    got = U.partner_counts(spark.createDataFrame(rows, "prompt_id string, sample_id long")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, 0, 3, 6), ("a", 3, 1, 2, 6), ("a", 4, 2, 1, 6), ("a", 9_000, 3, 0, 6), ("b", 7, 0, 0, 0)]


def test_token_stats(spark):
    rng = random.Random(1)
    data = {"a": [-0.1, -2.0, -0.5], "b": [-rng.expovariate(0.2) for _ in range(500)], "c": [-900.0, -901.0], "d": [-0.25]}
    rows = [(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)] + [("a", 9, float("nan")), ("a", 10, None)]
    got = {r.prompt_id: r for r in U.token_stats(spark.createDataFrame(rows, "prompt_id string, pos long, logprob double")).collect()}
    for k, vs in data.items():
        v = np.array(vs)
        assert got[k].n_tokens == len(v)
        assert got[k].mean_logprob == pytest.approx(v.mean()) and got[k].std_logprob == pytest.approx(v.std(), abs=1e-12)
        assert got[k].log_mass == pytest.approx(v.max() + np.log(np.exp(v - v.max()).sum()))
    row = U.token_features(spark.createDataFrame(rows[:3], "prompt_id string, pos long, logprob double")).first()
    assert row.semantic_energy == pytest.approx(-0.498775, abs=1e-6) and row.std_logprob == pytest.approx(0.817856, abs=1e-6)
    assert row.naive_perplexity == pytest.approx(2.378968, abs=1e-6) and row.naive_max_prob == pytest.approx(0.904837, abs=1e-6)
    with pytest.raises(ValueError):
        U.semantic_energy("max")


def test_cluster_entropy(spark):
    rows = [("p", c) for c in [0, 0, 0, 1, 2]] + [("q", 0)] * 4 + [("r", 5)]
    got = {r.prompt_id: r for r in U.cluster_entropy(spark.createDataFrame(rows, "prompt_id string, cluster_id long")).collect()}
    assert got["p"].semantic_entropy == pytest.approx(1.370951, abs=1e-6)
    assert got["q"].semantic_entropy == 0.0 and got["q"].avg_cluster_size == 4.0
    assert got["r"].num_samples == 1 and got["r"].avg_cluster_size == 1.0
    for r in got.values():
        assert 0 <= r.semantic_entropy <= math.log2(max(r.num_samples, 1)) + 1e-9


def _average_linkage(vectors, threshold):
    """Textbook average linkage over the full matrix of pair distances."""
    u = [v / np.linalg.norm(v) for v in vectors]
    groups = [[i] for i in range(len(u))]
    while len(groups) > 1:
        best = min(((1 - np.mean([u[i] @ u[j] for i in a for j in b]), x, y)
                    for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        if best[0] > 1 - threshold:
            break
        _, x, y = best
        groups[x] += groups.pop(y)
    return sorted(tuple(sorted(g)) for g in groups)


def _blobs(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dim))
    out = [centres[rng.integers(3)] + rng.normal(scale=0.45, size=dim) for _ in range(n)]
    return [out[rng.integers(i + 1)] if rng.random() < 0.3 else v for i, v in enumerate(out)]


@pytest.fixture(scope="module")
def blob_frame(spark):
    groups = {f"p{s}": _blobs(s, n) for s, n in enumerate([1, 2, 5, 17, 40])}
    rows = [(k, i, [float(x) for x in v]) for k, vs in groups.items() for i, v in enumerate(vs)]
    return groups, spark.createDataFrame(rows, "prompt_id string, sample_id long, vector array<double>").cache()


@pytest.mark.parametrize("local_limit, block", [(256, 1024), (4, 8), (0, 1024)])
def test_clusters_match_textbook_linkage(blob_frame, local_limit, block):
    """The batched path and the distributed rounds give the same clusters."""
    groups, df = blob_frame
    rows = clustering.cluster_samples(df, 0.7, local_limit, block).collect()
    for key, vs in groups.items():
        found = {}
        for r in rows:
            if r.prompt_id == key:
                found.setdefault(r.cluster_id, []).append(r.sample_id)
        assert sorted(tuple(sorted(m)) for m in found.values()) == _average_linkage(vs, 0.7)
        assert all(c == min(m) for c, m in found.items())


def test_prompts_of_one_block_are_compared_in_batches(spark, monkeypatch):
    """No pivots, and no call of Python for each prompt; prompts run across the ends of batches."""
    groups = [_blobs(100 + s, 1 + s % 7, 3 + s % 2) for s in range(60)]
    rows = [(k, i, [float(x) for x in v]) for k, vs in enumerate(groups) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "prompt_id int, sample_id long, vector array<double>")
    expected = sorted(clustering.cluster_samples(df, 0.7).collect())
    monkeypatch.setattr(clustering, "_pivoted", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        assert sorted(clustering.cluster_samples(df, 0.7, local_limit=0).collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_and_zero_vectors(spark):
    rows = [("same", i, [1.0, 2.0]) for i in range(6)] + [("zero", i, [0.0, 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "prompt_id string, sample_id long, vector array<double>")
    got = {r.prompt_id: r for r in U.cluster_entropy(clustering.cluster_weights(df)).collect()}
    assert got["same"].num_semantic_clusters == 1 and got["same"].num_samples == 6 and got["same"].semantic_entropy == 0.0
    assert got["zero"].num_semantic_clusters == 3


def test_pair_similarity_brute_force(spark, blob_frame):
    rng = random.Random(5)
    words = list("abcdefgh")
    texts = {k: [sorted(set(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(n)] for k, n in (("x", 9), ("y", 2), ("z", 1))}
    rows = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "prompt_id string, sample_id long, terms array<string>")
    got = {r.prompt_id: r.mean_similarity for r in U.term_pair_similarity(df).collect()}

    def s(a, b):
        return len(set(a) & set(b)) / len(b) if b else 0.0

    for k, ts in texts.items():
        pairs = [(s(a, b) + s(b, a)) / 2 for i, a in enumerate(ts) for b in ts[i + 1:]]
        assert got[k] == (pytest.approx(np.mean(pairs)) if pairs else None)
    groups, vdf = blob_frame
    got = {r.prompt_id: r.mean_similarity for r in U.vector_pair_similarity(vdf).collect()}
    for k, vs in groups.items():
        u = [v / np.linalg.norm(v) for v in vs]
        pairs = [a @ b for i, a in enumerate(u) for b in u[i + 1:]]
        assert got[k] == (pytest.approx(np.mean(pairs)) if pairs else None)


def test_letter_features(spark):
    rows = [("p", "A"), ("p", "B"), ("p", "b is right"), ("p", "3"), ("q", "7"), ("q", "8")]
    got = {r.prompt_id: r for r in U.letter_features(spark.createDataFrame(rows, "prompt_id string, text string")).collect()}
    p, q = got["p"], got["q"]
    assert (p.mcq_letter_consistency, p.mcq_num_unique_letters, p.mcq_parseable_ratio, p.mcq_mode_letter_count) == (
        pytest.approx(2 / 3), 2, 0.75, 2)
    assert (q.mcq_letter_consistency, q.mcq_num_unique_letters, q.mcq_parseable_ratio, q.mcq_letter_entropy) == (0.0, 0, 0.0, 2.0)


def test_entities_in_whole_texts(spark):
    far = "word " * 5000 + "New York, then PARIS and paris."
    prompts = spark.createDataFrame([("a", far), ("b", "nothing here"), ("c", "new york city")], "prompt_id string, prompt string")
    gaz = spark.createDataFrame([("new york", "GPE"), ("paris", "GPE"), ("new york city hall", "LOC")], "text_normalized string, label string")
    got = {(r.prompt_id, r.text_normalized): r.n for r in context.extract_entities(prompts, gaz).collect()}
    assert got == {("a", "new york"): 1, ("a", "paris"): 2, ("c", "new york"): 1}
    feats = {r.prompt_id: r for r in context.contextual_features(prompts, context.extract_entities(prompts, gaz)).collect()}
    assert feats["a"].num_entities == 3 and feats["a"].avg_entity_rarity == pytest.approx(-math.log(1.8))
    assert feats["b"].num_entities == 0 and feats["b"].avg_entity_rarity == 0.0 and feats["b"].entity_type_GPE == 0
    assert feats["a"].token_count == 5000 + 6 and set(CONTEXT_COLUMNS) < set(feats["a"].asDict())
    compat = context.contextual_features(prompts, context.extract_entities(prompts, gaz), compat=True)
    assert compat.filter("prompt_id = 'b'").first().entity_type_GPE is None


def test_known_frequencies(spark):
    ents = spark.createDataFrame([("a", "zanzibar", "GPE", 1)], "prompt_id string, text_normalized string, label string, n long")
    freq = spark.createDataFrame([("zanzibar", 0.1)], "text_normalized string, frequency double")
    row = context.entity_rarity(ents, frequencies=freq).first()
    assert row.num_rare_entities == 1 and row.avg_entity_rarity == pytest.approx(-math.log(1.1))


def test_feature_groups():
    names = ["naive_max_prob", "mean_logprob", "semantic_entropy", "num_entities", "mcq_first_token_prob", "mcq_parseable_ratio",
             "qtype_how", "domain_IS", "avg_cluster_size"]
    got = matrix.feature_groups(names)
    assert got["Baseline: Naive Confidence"] == ["naive_max_prob", "mean_logprob"]
    # "entities" does not contain "entity", so plain counts stay out of the group
    assert got["Context Only"] == ["mcq_first_token_prob", "mcq_parseable_ratio", "qtype_how"]
    assert got["Full Model"] == names
    assert matrix.without_prefix(names)[-1] == "avg_cluster_size" and "domain_IS" not in matrix.without_prefix(names)


def test_column_helpers(spark):
    df = spark.createDataFrame([("p", "d", 1, 0.5, "x")], "prompt_id string, domain string, hallucination_label int, f double, g string")
    assert matrix.feature_columns(df) == ["f", "g"] and matrix.numeric_columns(df) == ["hallucination_label", "f"]
    assert set(METADATA_COLUMNS) >= {"prompt_id", "split"}
    onehot = matrix.encode_domain(df.withColumn("domain", F.lit("Finance"))).first()
    assert [onehot[f"domain_{d}"] for d in DOMAINS] == [0, 0, 1, 0, 0]


def test_impute(spark):
    rows = [(1, 1.0, None, "train"), (2, float("nan"), None, "train"), (3, 5.0, None, "train"), (4, None, None, "test"), (5, 100.0, None, "test")]
    df = spark.createDataFrame(rows, "id int, a double, b double, split string")
    got = {r.id: r.a for r in matrix.impute(df, ["a", "b"], "mean", df.filter("split = 'train' and not isnan(a)")).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 5.0, 4: 3.0, 5: 100.0}
    med = {r.id: (r.a, r.b) for r in matrix.impute_residual(df, ["a", "b"]).collect()}
    assert med[4] == (5.0, 0.0) and med[2] == (5.0, 0.0)
    assert matrix.impute(df, ["a"], "zero").filter("a = 0").count() == 2
    with pytest.raises(ValueError):
        matrix.impute(df, ["a"], "guess")


def test_selection(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.4)
        rows.append((i, y, y + rng.random() * 0.1, rng.random(), 7.0, -rng.random()))
    df = spark.createDataFrame(rows, "id int, y int, strong double, noise double, flat double, low double")
    cols = ["strong", "noise", "flat", "low"]
    for method in ("mutual_info", "f_classif", "chi2", "unknown"):
        got = selection.score_features(df, cols, "y", method, k_best=1).collect()
        assert {r.feature for r in got} == {"strong", "noise", "low"}
        assert [r.feature for r in got if r.selected] == ["strong"]
    assert selection.k_allowed(49, 41) == 9 and selection.k_allowed(500, 41) == 15 and selection.k_allowed(3, 41) == 1
    mi = {r.feature: r.score for r in selection.mutual_information(df, ["strong"], "y").collect()}
    p = np.mean([r[1] for r in rows])
    assert 0.5 < mi["strong"] / -(p * np.log(p) + (1 - p) * np.log(1 - p)) <= 1.0 + 1e-9


def _plain_names(rows, names):
    """(key, name, label): how often, by comparing token lists at every place."""
    from collections import Counter

    out = Counter()
    punct = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for key, text in rows:
        toks = [w.strip(punct) for w in (text or "").lower().split()]
        for name, label in names:
            want = name.split(" ")
            for i in range(len(toks) - len(want) + 1):
                if toks[i : i + len(want)] == want:
                    out[key, name, label] += 1
    return out


@pytest.mark.parametrize("most_names, heavy", [(2_000_000, None), (0, 1_000_000), (0, 5)], ids=["broadcast", "joined", "heavy apart"])
def test_names_of_many_words_and_a_run_in_every_prompt(spark, monkeypatch, most_names, heavy):
    """Names that begin alike, contain one another, have a dozen words, or two labels; one run is in all prompts, twice in some."""
    from riskloom.operators import joins

    monkeypatch.setattr(context, "MOST_NAMES", most_names)
    if heavy:
        monkeypatch.setattr(joins, "HEAVY", heavy)
    long = "the bank for the settlement of all the accounts of the world"
    names = [("the", "ORG"), ("the bank", "ORG"), (long, "ORG"), ("paris", "GPE"), ("paris", "PERSON"), ("bank for", "ORG"), ("world paris", "LOC"), ("absent name", "LOC")]
    rows = [(i, f"The report {i}, by The Bank" + (f" -- {long.title()}! Paris" if i % 4 == 0 else "") + (" paris paris." if i % 5 == 0 else ""))
            for i in range(40)] + [(90, None), (91, ""), (92, "the"), (93, " ! ? "), (94, "world  Paris,")]
    df = spark.createDataFrame(rows, "prompt_id int, prompt string").repartition(3)
    got = context.extract_entities(df, spark.createDataFrame(names, "text_normalized string, label string")).collect()
    assert {(r.prompt_id, r.text_normalized, r.label): r.n for r in got} == dict(_plain_names(rows, names)) and len(got) > 100


def test_no_names(spark):
    df = spark.createDataFrame([(1, "a b")], "prompt_id int, prompt string")
    assert not context.extract_entities(df, spark.createDataFrame([], "text_normalized string, label string")).count()


def test_token_table_and_top_entropy(spark):
    from riskloom.operators import tokens

    nan = float("nan")
    rows = [("a", 0, [-0.1, nan, None, -2.0], None), ("a", 1, None, [{"x": -0.2, "y": -3.0, "z": -2.0}, {"x": -0.1}]),
            ("b", 0, None, [{"x": -0.5, "y": -0.6, "z": nan}]), ("c", 0, [], []), ("d", 0, None, None)]
    df = spark.createDataFrame(rows, "prompt_id string, sample_id long, logprobs array<double>, top_logprobs array<map<string,double>>")
    got = {(r.prompt_id, r.sample_id, r.pos): r.logprob for r in tokens.token_table(df, ["prompt_id", "sample_id"]).collect()}
    assert got == {("a", 0, 0): -0.1, ("a", 0, 3): -2.0, ("a", 1, 0): -0.2, ("a", 1, 1): -0.1, ("b", 0, 0): -0.5}

    def entropy(values):
        p = [math.exp(v) for v in values]
        p = [x / sum(p) for x in p] if sum(p) > 1 else [*p, 1 - sum(p)]
        return -sum(x * math.log(x) for x in p if x > 0)

    for k, first in ((10, [-0.2, -3.0, -2.0]), (2, [-0.2, -2.0])):
        top = tokens.top_table(df, ["prompt_id", "sample_id"], k)
        out = {r.prompt_id: r.top_k_entropy for r in tokens.top_k_entropy(top, group=["sample_id"]).collect()}
        assert out == {"a": pytest.approx((entropy(first) + entropy([-0.1])) / 2), "b": pytest.approx(entropy([-0.5, -0.6]))}
    table = tokens.token_table(df, ["prompt_id"])
    real = {r.prompt_id: r.naive_top_k_entropy for r in U.token_features(table, entropies=tokens.top_k_entropy(top, group=["sample_id"])).collect()}
    assert real["b"] > 0.5 and {r.naive_top_k_entropy for r in U.token_features(table).collect()} == {0.0}
