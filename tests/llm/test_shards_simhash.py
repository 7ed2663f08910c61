"""Shards and near duplicates against plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries as Q
from riskloom.llm import shards, simhash
from riskloom.llm.components import components
from tests.llm.test_text_jobs import clashing, got


def check_shards(rows, source, n):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source), key=str)
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(n)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_shards(spark, sf, sf_rows, odd_docs, odd_rows, no_docs):
    check_shards(Q.op2_shards(spark, sf).collect(), sf_rows, 8)
    check_shards(shards.split(clashing(odd_docs), 3, least_ranges=8).collect(), [r[:2] for r in odd_rows], 3)
    assert shards.split(no_docs, 4).collect() == []
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot row").alias("text"))
    check_shards(shards.split(same, 8).collect(), [(7, "hot row")] * 3000, 8)
    named = shards.split(odd_docs.withColumn("source", F.coalesce("source", F.lit("?"))), 3, key="source").collect()
    assert len(named) == len(odd_rows)


def plain_fingerprint(t):
    import xxhash

    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    packed = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(packed[i + 1 :] ^ packed[i]) <= 3).tolist():
            root[find(i + 1 + j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_simhash(spark, sf, sf_rows, odd_docs, odd_rows, no_docs):
    assert got(Q.op1_simhash(spark, sf), "doc_id", "fingerprint", "component_id") == plain_classes(sf_rows)
    small = [r[:2] for r in odd_rows if len(r[1] or "") < 50_000]
    few = clashing(odd_docs.where("coalesce(length(text), 0) < 50000"))
    assert got(simhash.near_duplicates(few, ["doc_id", "fp"]), "doc_id", "fingerprint", "component_id") == plain_classes(small)
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, _, c in plain_classes([r[:2] for r in odd_rows])}, key=str)
    assert simhash.keep_first(no_docs).collect() == [] and simhash.near_duplicates(no_docs, ["doc_id"]).collect() == []


def plain_roots(fps, distance):
    left, roots = set(fps), {}
    while left:
        seed = min(left)
        left.remove(seed)
        group, queue = [seed], [seed]
        while queue:
            x = queue.pop()
            near = [y for y in left if ((x ^ y) % (1 << 64)).bit_count() <= distance]
            left.difference_update(near)
            group += near
            queue += near
        roots |= {x: min(group) for x in group}
    return roots


@pytest.mark.parametrize("most", [20_000, 3])
def test_links(spark, most):
    """Dense families, chains and loners; large buckets go by points around the members."""
    rng = random.Random(most)
    fps = set()
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < .4:
                x ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, 7, 15}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(distinct, most_in_list=most)
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {x: roots.get(x, x) for x in signed} == plain_roots(signed, 3)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(900, 901), (5, 5)], "a long, b long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(300)}, 900: 900, 901: 900}


def test_rounds_of_few_edges_have_few_files(spark, monkeypatch):
    from riskloom.llm import components as C

    files, store = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, stem: (out := store(df, stem), files.append(len(out.inputFiles())))[0])
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
        assert {r.root for r in C.components(edges).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len(files) > 2 and set(files[1:]) == {1}
