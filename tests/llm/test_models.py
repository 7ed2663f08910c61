"""The learned scorers: gradients and marginals against plain sums, counts against plain Python, held-out quality."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import language_model as lm
from riskloom.llm import queries as Q
from riskloom.llm import toxicity
from tests.llm.test_text_jobs import clashing


def plain_counts(rows):
    cut = lambda t: lm.tokens_of((t or "").encode())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if i is not None and not held(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, len(cut(t)), sum(w in c for w in cut(t)), n, round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in cut(t)), 6)) for i, t in rows), key=str)


@pytest.mark.parametrize("most", [150_000, 50])
def test_counts(spark, sf, sf_rows, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = lm.score(docs, ["doc_id"], lm.not_held_out(), rounds=1, most_in_memory=most).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == plain_counts(sf_rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    out = lm.score(clashing(odd_docs), ["doc_id", "n_words"], lm.not_held_out(), rounds=1, share=1.0).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == plain_counts([r[:2] for r in odd_rows])
    assert lm.score(no_docs, ["doc_id"], lm.not_held_out()).collect() == []


def test_network_is_a_distribution_and_its_slope_is_right():
    net = lm.Network(5, 3, 4)
    rng = np.random.default_rng(1)
    p = {k: x.astype(np.float64) for k, x in net.fresh(rng.random(12)).items()}
    for x in p.values():
        x += rng.standard_normal(x.shape) * .3
    states = rng.standard_normal((1, 5))
    assert sum(np.exp(net.log_prob(p, states, np.array([s]))[0][0]) for s in range(12)) == pytest.approx(1)
    slots, h = rng.integers(0, 12, (6, 3)), np.zeros((3, 5))
    on = np.ones((6, 3), bool)
    on[4:, 2] = False
    starts = np.zeros((6, 3), bool)
    starts[2, 1] = True
    _, grads, _ = net.slope(p, slots, on, h, starts)
    for name, g in grads.items():
        i = tuple(rng.integers(0, s) for s in p[name].shape) if name != "table" else (int(slots[1, 0]), 2)
        values = []
        for d in (1e-3, -1e-3):
            p[name][i] += d
            values.append(net.log_prob(p, net.run(p, slots, h, None, starts)[0][on], slots[on])[0].sum())
            p[name][i] -= d
        assert g[i] == pytest.approx((values[0] - values[1]) / 2e-3, rel=2e-2, abs=2e-3), name


def test_state_is_carried(monkeypatch):
    net = lm.Network(4, 2, 3)
    p = net.fresh(np.ones(6))
    rng = np.random.default_rng(2)
    data = [rng.integers(0, 6, n).astype(np.int32) for n in (70, 33, 32, 1, 64)]
    flat, n = np.concatenate(data), np.array([len(x) for x in data])
    a, b = lm.log_probs(net, p, flat, n, width=7), lm.log_probs(net, p, flat, n, together=2, width=100)
    assert np.allclose(a, b, atol=1e-4)


def test_long_texts_run_beside_others():
    net = lm.Network(4, 2, 3)
    p = net.fresh(np.ones(6))
    rng = np.random.default_rng(6)
    n = np.array([32] * 15 + [320] + [32] * 15)
    data = [rng.integers(0, 6, x).astype(np.int32) for x in n]
    alone = np.concatenate([lm.log_probs(net, p, x, np.array([len(x)])) for x in data])
    steps = []
    run = net.run
    net.run = lambda p, slots, *rest: (steps.append(len(slots)), run(p, slots, *rest))[1]
    assert np.allclose(lm.log_probs(net, p, np.concatenate(data), n, together=4), alone, atol=1e-5)
    assert sum(steps) == 320  # in blocks of four texts each it would be 544


def test_sums_round_like_rows():
    x = np.random.default_rng(7).standard_normal((50, 32)).astype(np.float32)
    assert (lm._sum(np.ascontiguousarray(x.T)) == x.sum(1)).all()


def test_tokens_of_whole_batches(spark, odd_rows):
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in odd_rows] + ["", " ", "\x00 A\x0bb\r"], pa.string())], names=["text"])
    for part in (batch, batch.slice(5), batch.slice(7, 1)):
        want = [lm.tokens_of((x or "").encode()) for x in part.column(0).to_pylist()]
        tokens, n = lm.tokens_in(part, "text")
        assert [x.encode() for x in tokens.to_pylist()] == [w for x in want for w in x] and n.tolist() == [*map(len, want)]
        assert lm.places_in(tokens, [b"the", b""]).tolist() == [{b"the": 0, b"": 1}.get(w, -1) for x in want for w in x]
        at = np.flatnonzero([w != b"the" for x in want for w in x])
        words, times = lm.rare_in(tokens, n, at)
        assert [dict(zip(*x)) for x in zip(words.to_pylist(), times.to_pylist())] == [dict(Counter(w for w in x if w != b"the")) for x in want]


def test_sums_of_runs():
    rng = np.random.default_rng(8)
    sizes = np.array([40, 1, 3, 24, 25, 2, 1])
    rows, first = rng.standard_normal((sizes.sum(), 5)).astype(np.float32), np.cumsum(sizes) - sizes
    assert np.allclose(lm._run_sums(first, len(rows))(rows), np.add.reduceat(rows, first), atol=1e-5)


def test_training_beats_counts(spark, sf):
    out = lm.score(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], lm.not_held_out(), share=1.0)
    held = out.where(F.coalesce(toxicity.remainder("doc_id", 5) == 1, F.lit(False))).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_every_learnable_text_is_trained_on_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(300)] + [(300, None), (301, "")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(lm, "_averaged", lambda spark, net, flat, chosen, *rest: (seen.extend(chosen.select("doc_id").collect()), flat)[1])
    lm.score(docs, ["doc_id"], lm.not_held_out())
    assert sorted(r.doc_id for r in seen) == sorted(r.doc_id for r in docs.where(lm.not_held_out()).collect())


def test_streams_widen_with_the_row():
    net = lm.Network(4, 2, 3)
    flat, rng = net.pack(net.fresh(np.ones(6))), np.random.default_rng(3)
    widths = []
    slope = net.slope
    net.slope = lambda p, slots, *rest: (widths.append(slots.shape[1]), slope(p, slots, *rest))[1]
    for n in (40, 5_000, 400_000):
        lm.train(net, flat, rng.integers(0, 6, n).astype(np.int32), np.array([n]), together=(8, 64))
    assert sorted(set(widths)) == [1, 8, 64]


def test_marginals():
    rng = np.random.default_rng(4)
    move = rng.standard_normal((2, 2))
    lifts = [rng.standard_normal(n) for n in (6, 4, 1)]
    table, n = toxicity.table_of(lifts)
    odds = toxicity.marginal_odds(table, n, move)[0]
    for k, x in enumerate(lifts):
        sums = np.zeros((len(x), 2))
        for ys in product((0, 1), repeat=len(x)):
            w = math.exp(sum(l * y for l, y in zip(x, ys)) + sum(move[a, b] for a, b in zip(ys, ys[1:])))
            for t, y in enumerate(ys):
                sums[t, y] += w
        assert np.allclose(odds[: len(x), k], np.log(sums[:, 1] / sums[:, 0]))


def test_toxicity(spark, odd_docs, odd_rows, no_docs):
    sf = "/root/testdata/sf0.01"
    out = Q.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) / len(out) > .93 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .3) for r in out)
    assert sum(r.predicted for r in out if r.toxic) >= .6 * sum(r.toxic for r in out)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample, share = toxicity.training_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text", "toxic", 500, 500, lambda c: F.lit(True))
    chain = toxicity.fit(sample, share)
    rows = spark.createDataFrame([(1, "the of and IDIOT! de la the"), (2, ""), (3, None), (4, "é the of")], "doc_id long, text string")
    by = {r.doc_id: r for r in toxicity.score(rows, ["doc_id"], chain).collect()}
    assert by[1].toxic_spans == "11:17" and by[2].score == by[3].score < .3 and by[4].toxic_spans == ""
    assert toxicity.score(clashing(odd_docs), ["doc_id", "spans"], chain).count() == len(odd_rows)
    assert toxicity.score(no_docs, ["doc_id"], chain).collect() == []
    assert toxicity.fit([], 0.0).weights == {}
