"""Near duplicates by MinHash: banded candidates, sequential Bayesian pruning, exact verification.

Texts with the same shingle set fold to one node.  Band keys put nodes into buckets; a pair of similarity
0.8 shares none of 36 keys of five rows with probability 6e-7.  Signatures of candidates are compared batch by
batch and a pair goes as soon as the posterior probability of its being similar falls under ``miss``.
What survives is verified on the full sets of 64-bit shingle hashes, so every link is right.

No bucket is gathered whole and no bucket gives all its pairs: each node first meets the least nodes of its
buckets, verified links fold nodes into components, and only buckets that still hold several
components are compared further, in blocks of bounded size that give a forest of links.  A pair is compared in the
first bucket it shares.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, SLICE, row_wise, slices, text_bytes
from riskloom.llm.components import components
from riskloom.session import drop_stage, materialize

ROWS, BANDS, BATCH = 5, 36, 60
HASHES = ROWS * BANDS
#: Rows of a bucket that one group compares with one another or with as many others, and the shingles they have, about.
BLOCK, BLOCK_SHINGLES = 512, 200_000

_random = np.random.default_rng(20_11)
_FACTORS = _random.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_MASKS = _random.integers(0, 1 << 32, HASHES, np.uint32)
_STEPS = _random.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _random.integers(0, 1 << 63, BANDS, np.uint64)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """XXH64 of words, looked up once."""

    MOST = 400_000

    def __init__(self) -> None:
        from xxhash import xxh64_intdigest

        self.digest = xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = out = self.digest(word, 42)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _RIGHT
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], known: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``width``, but not none, are one shingle."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    if not width:
        return h
    n = len(h) - width + 1
    out = h[:n].copy()
    for j in range(1, width):
        out = _mixed(out * _LEFT + h[j : j + n])
    return np.unique(_mixed(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each of ``HASHES`` permutations over the set."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 4096):
        least = np.minimum(least, ((h[a : a + 4096, None] ^ _MASKS) * _FACTORS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = _mixed((rows * _STEPS).sum(axis=1, dtype=np.uint64) ^ _BAND_SEEDS)
    return keys & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)  # the last bits name the band


def short_signature(least: np.ndarray) -> np.ndarray:
    """One byte of each value; two different values agree once in 256."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_matches(similar: float, miss: float) -> list[int]:
    """For each number of batches seen, the fewest agreeing bytes at which a pair stays.

    Under a flat prior the posterior of the agreement rate after m of n is Beta(m + 1, n - m + 1); a pair
    goes when it puts less than ``miss`` on rates that ``similar`` sets have.
    """
    rate, out = similar + (1 - similar) / 256, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below = np.cumsum([comb(n + 1, k) * rate**k * (1 - rate) ** (n + 1 - k) for k in range(n + 2)])
        out.append(int(np.argmax(below >= miss)))
    return out


def _printed(docs: DataFrame, keep: list[str], text: str, width: int) -> DataFrame:
    from xxhash import xxh3_128_intdigest

    def compute(batches):
        known = WordHashes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for x in text_bytes(batch, text):
                hashes = shingle_hashes(x.translate(LOWER).split(), known, width)
                digest = xxh3_128_intdigest(hashes.tobytes())
                least = signature(hashes)
                found = (len(hashes), *np.array([digest >> 64, digest & (1 << 64) - 1], np.uint64).view(np.int64).tolist(),
                         band_keys(least).tobytes(), short_signature(least).tobytes())
                for column, value in zip(rows, found):
                    column.append(value)
            yield rows

    return row_wise(docs, keep, text, {"__n": "long", "__d1": "long", "__d2": "long", "__keys": "binary", "__sig": "binary"}, compute)


def _memberships(batches):
    """(key, node) of every band."""
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(nodes, BANDS))], names=["key", "node"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


class Pruner:
    """Sequential comparison of signature pairs."""

    def __init__(self, percent: int, miss: float) -> None:
        self.percent, self.fewest = percent, least_matches(percent / 100, miss)

    def agreeing(self, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that stay, and how many bytes of theirs agree.  Sizes too far apart can't be similar."""
        at = np.flatnonzero(100 * np.minimum(n_left, n_right) >= self.percent * np.maximum(n_left, n_right))
        same = np.zeros(len(at), np.int64)
        for k, fewest in enumerate(self.fewest):
            part = slice(k * BATCH, (k + 1) * BATCH)
            same += (left[at if len(left) > 1 else 0, part] == right[at, part]).sum(axis=1)
            stays = same >= fewest
            at, same = at[stays], same[stays]
        return at, same


def _pruned_stars(percent: int, miss: float):
    def run(batches):
        prune = Pruner(percent, miss)
        for batch in batches:
            if not len(batch):
                continue
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            at, same = prune.agreeing(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(same)], names=["a", "b", "same"])

    return run


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, neither of them empty."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(band: int, left: np.ndarray, right: np.ndarray | None, root: np.ndarray, n: np.ndarray, signatures: np.ndarray,
           sets: list, prune: Pruner) -> list[tuple[int, int]]:
    """Links among rows ``left``, or from them to ``right``, that join all components which similar pairs would join.

    Pairs of one component, those that an earlier band compares, and those already joined here are passed over.
    """
    top = {r: r for r in np.unique(root).tolist()}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    bands = signatures.reshape(-1, BANDS, ROWS)[:, :band]
    for k, i in enumerate(left.tolist()):
        others = left[k + 1 :] if right is None else right
        others = others[root[others] != root[i]]
        if band and len(others):
            others = others[~(bands[others] == bands[i]).all(axis=2).any(axis=1)]
        at, same = prune.agreeing(signatures[i : i + 1], signatures[others], n[i], n[others])
        mine = None
        for j in others[at[np.argsort(-same, kind="stable")]].tolist():
            a, b = find(int(root[i])), find(int(root[j]))
            if a == b:
                continue
            mine = np.frombuffer(sets[i], np.uint64) if mine is None else mine
            if similar(mine, np.frombuffer(sets[j], np.uint64), prune.percent):
                top[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _linked_blocks(percent: int, miss: float):
    """Links of each group of rows (key, p, q): block p against block q of a bucket.  Rows come sorted by group."""
    def links_of(batch: pa.RecordBatch, prune: Pruner, edges: list[int]) -> pa.RecordBatch:
        key, p, q, block, node, root, n = (batch.column(i).to_numpy() for i in range(7))
        signatures, sets = _matrix(batch.column(7)), batch.column(8).to_pylist()
        out = []
        for start, end in zip(edges, edges[1:]):
            own = np.arange(start, end)
            if p[start] == q[start]:
                left, right = own, None
            else:
                left, right = own[block[own] == p[start]], own[block[own] == q[start]]
            out += forest(int(key[start]) & 63, left, right, root, n, signatures, sets, prune)
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    def run(batches):
        prune, rest = Pruner(percent, miss), None
        for batch in batches:
            if not len(batch):
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(len(batch) - 1, bool)
            for i in range(3):
                column = batch.column(i).to_numpy()
                new |= column[1:] != column[:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            rest = batch.slice(edges[-1])
            if len(edges) > 1:
                yield links_of(batch.slice(0, edges[-1]), prune, edges)
        if rest is not None:
            yield links_of(rest, prune, [0, len(rest)])

    return run


def _hash_sets(width: int):
    def run(batches):
        known = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = [shingle_hashes(x.translate(LOWER).split(), known, width).tobytes() for x in text_bytes(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _mixed_buckets(members: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, once for each block (p, q) to be compared, sorted by it."""
    seen = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    several = seen.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("all")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("long")
    rows = seen.join(several, "key").select("key", "node", "root", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"))
    rows = rows.join(nodes.select("node", "sig"), "node").join(sets, "node")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "root", "n", "sig", "set")
    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def link_forest(nodes: DataFrame, docs: DataFrame, doc: str, text: str, percent: int, width: int, miss: float) -> DataFrame:
    """(node, root) of every node that is linked with another."""
    band = nodes.select("node", "keys").mapInArrow(_memberships, "key long, node long")
    common = band.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1").drop("size")
    members = materialize(band.join(common, "key").join(nodes.select("node", "n"), "node").select("key", "node", "hub", "n"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("at.__doc").alias("doc"), F.col("at.__th").alias("th"))
    whole = docs.select(F.col(f"`{doc}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"))
    found = wanted.join(whole, wanted["doc"].eqNullSafe(whole["id"]) & (wanted["th"] == whole["hash"]))
    sets = materialize(found.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(_hash_sets(width), "node long, set binary"), "sets")

    def two(table: DataFrame, *columns: str) -> list[DataFrame]:
        return [table.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in ("a", "b")]

    left, right = two(nodes, "n", "sig")
    stars = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    near = stars.mapInArrow(_pruned_stars(percent, miss), "a long, b long, same long")
    closest = near.groupBy("a").agg(F.max(F.struct("same", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    left, right = two(sets, "set")
    links = closest.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_verified(percent), "a long, b long")

    roots = materialize(components(materialize(links, "links")), "roots")
    blocks = _mixed_buckets(members, roots, nodes, sets)
    new = materialize(blocks.mapInArrow(_linked_blocks(percent, miss), "a long, b long"), "links")
    if not new.isEmpty():
        known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = materialize(components(known.unionByName(new)), "roots")
    for stage in (members, sets, new):
        drop_stage(stage)
    return roots


def near_duplicates(docs: DataFrame, keep: list[str], doc: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5,
                    miss: float = 1e-6) -> DataFrame:
    """``keep`` columns, ``n_shingles``, ``component_id`` and ``kept`` of each row.

    Rows link where ``100 * shared >= percent * all`` of their distinct ``width``-word shingles; fewer words are one
    shingle.  ``component_id`` is the least document id that can be reached.  A null, empty or wordless text has
    no shingle and no link.  Equal texts and repeated rows share a component; equal ids are told apart by
    their texts.  Null ids count for no component; where a component has no other its id is null.  ``kept`` holds
    where the two ids are equal (null and null too).  An empty table gives no rows.  Other columns may have any name; kept ones that bear
    a new name give way.
    """
    new = ["n_shingles", "component_id", "kept"]
    keep = [c for c in dict.fromkeys([*keep, doc]) if c not in new]
    marked = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], F.col(f"`{doc}`").alias("__doc"), F.xxhash64(F.col(f"`{text}`")).alias("__th"))
    printed = materialize(_printed(marked, [*keep, "__doc", "__th"], text, width), "printed")
    folded = printed.where("__n > 0").groupBy("__d1", "__d2").agg(
        F.min("__doc").alias("least"), F.min(F.struct("__doc", "__th")).alias("at"), F.first("__n").alias("n"),
        F.first("__keys").alias("keys"), F.first("__sig").alias("sig"))
    nodes = materialize(folded.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    roots = link_forest(nodes, docs, doc, text, percent, width, miss)
    rooted = nodes.join(roots, "node", "left").select("__d1", "__d2", "least", F.coalesce("root", "node").alias("root"))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        F.col("__d1").alias("d1"), F.col("__d2").alias("d2"), "component_id")
    out = printed.join(classes, (printed["__n"] > 0) & (printed["__d1"] == classes["d1"]) & (printed["__d2"] == classes["d2"]), "left")
    component = F.when(F.col("__n") > 0, F.col("component_id")).otherwise(F.col("__doc"))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("__doc")).alias("kept"))
