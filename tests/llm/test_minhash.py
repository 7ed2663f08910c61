from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import minhash
from riskloom.llm.common import LOWER


def shingle_set(text, width):
    words = text.translate(LOWER).split()
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(width))))


def brute(rows, width, percent=80):
    """(id, shingles, component, kept) of (id, text) rows by plain sets and an inverted index."""
    sets = [shingle_set((x or "").encode(), width) for _, x in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, own in enumerate(sets):
        for j, both in Counter(j for g in own for j in held[g]).items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for g in own:
            held[g].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return Counter(out)


def found(frame):
    return Counter(map(tuple, frame.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_sf_rows(spark, sf, sf_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(minhash.near_duplicates(docs, ["doc_id"], width=2)) == brute(sf_rows, 2)


@pytest.mark.parametrize("width", [2, 5])
def test_odd_rows(odd_docs, odd_rows, width):
    docs = odd_docs.withColumnsRenamed({"lang": "component_id", "source": "__n"}).withColumn("node", F.lit("x"))
    out = minhash.near_duplicates(docs, ["doc_id", "component_id", "node"], width=width)
    assert out.columns == ["doc_id", "node", "n_shingles", "component_id", "kept"]
    assert found(out) == brute([r[:2] for r in odd_rows], width)


def test_empty_table(no_docs):
    assert not minhash.near_duplicates(no_docs, ["doc_id"]).count()


def test_large_group_of_near_copies(spark, monkeypatch):
    """A group whose members are partly under 0.8 to one another, in many blocks, beside texts that share a passage."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 14))):
            words[at] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([*base[:80], *(f"y{i}-{j}" for j in range(40))])) for i in range(150)]
    want = brute(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(docs, ["doc_id"], width=2)) == want
    assert len({c for _, _, c, _ in want}) > 150


def test_bound_on_candidates():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-6
    fewest = minhash.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(2)
    rate = 0.8 + 0.2 / 256
    seen = np.cumsum(rng.random((20_000, minhash.HASHES)) < rate, axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (seen >= fewest).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(50, 400), st.integers(0, 200), st.integers(0, 1 << 30))
def test_signature_estimates(shared, own, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, shared + 2 * own, np.uint64))
    a, b = h[: len(h) - own], np.concatenate([h[: len(h) - 2 * own], h[len(h) - own :]])
    left, right = (minhash.short_signature(minhash.signature(x)) for x in (a, b))
    true = (len(h) - 2 * own) / len(h)
    assert abs((left == right).mean() - true) < 0.22
