"""Near duplicates by SimHash fingerprints, found through blocks that close pairs must share."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, row_wise, text_bytes
from riskloom.llm.components import components
from riskloom.session import materialize

SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits over the XXH64 of every ``width``-word shingle, repeats included; 0 without a word."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-width].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    n, ones = len(hashes), np.zeros(64, np.int64)
    packed = np.array(hashes, np.uint64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(packed[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """``keep`` columns and the fingerprint of each whole text as a signed long ``fp``."""
    def compute(batches):
        for batch in batches:
            yield [np.array([fingerprint(x, width) for x in text_bytes(batch, text)], np.uint64).view(np.int64).tolist()]

    return row_wise(docs, keep, text, {"fp": "long"}, compute)


def _cuts(blocks: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of ``blocks - distance`` blocks; two fingerprints within ``distance`` agree on one of them."""
    return [sum(c) for c in combinations(_cuts(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join every two members linked through members; at most one less than members."""
    edges, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                queue += list(found)
                edges += [(x, y) for y in found]
                rest = rest[~near]
    return edges


def _bucket_edges(distance: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            edges = []
            for a, b in zip(at, at[1:]):
                if b - a == 2:
                    if int(values[a] ^ values[a + 1]).bit_count() <= distance:
                        edges.append((values[a], values[a + 1]))
                else:
                    edges += forest(values[a:b], distance)
            out = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _variants(distance: int, masks: list[int]):
    """Points around each fingerprint, outside the bits that its bucket fixes.

    Two members are within ``distance`` if and only if a point is within the larger half of it from one
    and within the smaller half from the other; rows grow with the members, not with pairs.
    """
    near, far = distance // 2, distance - distance // 2

    def run(batches):
        flips = []
        for mask in masks:
            free = [1 << i for i in range(64) if not mask >> i & 1]
            flips.append([(sum(c), k <= near) for k in range(far + 1) for c in combinations(free, k)])
        tables = [(np.array([f for f, _ in x], np.uint64), np.array([n for _, n in x])) for x in flips]
        for batch in batches:
            for which, bucket, fp in zip(*(c.to_pylist() for c in batch.columns)):
                points, near_ones = tables[which]
                z = (np.uint64(fp % (1 << 64)) ^ points).view(np.int64)
                n = len(z)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket)), pa.array(z), pa.array(near_ones), pa.array(np.full(n, fp))],
                                                 names=["bucket", "z", "near", "fp"])

    return run


def links(distinct: DataFrame, distance: int = 3, blocks: int = 6, most_in_list: int = 20_000) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fp`` within ``distance``.

    A fingerprint goes to one bucket for each choice of ``blocks - distance`` of its ``blocks`` blocks; a
    close pair shares one.  Buckets are counted first.  A bucket of up to ``most_in_list`` fingerprints is
    compared in one list and gives a spanning forest; a larger one is dealt again by points between close
    pairs, so neither path gathers an unbounded group or emits all pairs.
    """
    masks = block_masks(distance, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("bucket"))
                     for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.which", "k.bucket", "fp")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = rows.join(shared, "bucket")
    lists = members.where(F.col("n") <= most_in_list).groupBy("bucket").agg(F.collect_list("fp").alias("fps")).select("fps")
    edges = lists.mapInArrow(_bucket_edges(distance), "a long, b long")
    if (shared.agg(F.max("n")).first()[0] or 0) > most_in_list:
        around = (members.where(F.col("n") > most_in_list).select("which", "bucket", "fp")
                  .mapInArrow(_variants(distance, masks), "bucket long, z long, near boolean, fp long"))
        hubs = around.groupBy("bucket", "z").agg(F.bool_or("near").alias("near"), F.min("fp").alias("b"), F.max("fp").alias("top"))
        hubs = hubs.where("near and b < top").select("bucket", "z", "b")
        edges = edges.unionByName(around.join(hubs, ["bucket", "z"]).where("fp > b").select(F.col("fp").alias("a"), "b"))
    return edges.distinct()


def classes(printed: DataFrame, doc: str = "doc_id", distance: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, component_id, least): class of each fingerprint; ``component_id`` is the least document id in it.

    Copies fold into their fingerprint first.  Null ids don't count for the least one, which is null where no
    document of the class has an id.  ``root`` names the class.
    """
    distinct = materialize(printed.groupBy("fp").agg(F.min(doc).alias("least")), "fingerprints")
    roots = components(links(distinct, distance, blocks))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, keep: list[str], doc: str = "doc_id", text: str = "text", distance: int = 3,
                    blocks: int = 6) -> DataFrame:
    """``keep`` columns, ``fingerprint`` (16 hex digits), ``component_id`` and ``__root`` of each row.

    Rows with null or empty text have fingerprint zero and are linked like any other; repeated rows stay.
    """
    keep = list(dict.fromkeys([*keep, doc]))
    printed = materialize(fingerprints(docs, keep, text), "printed")
    found = classes(printed, doc, distance, blocks).select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), "component_id")
    keep = [c for c in keep if c not in ("fingerprint", "component_id")]
    return printed.join(found, printed["fp"] == F.col("__fp")).select(
        *[F.col(f"`{c}`") for c in keep], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "__root")


def keep_first(docs: DataFrame, doc: str = "doc_id", text: str = "text", distance: int = 3, blocks: int = 6) -> DataFrame:
    """One row of each near-duplicate class: that of the least id; of rows that share it, one by row hash.

    Rows meet their class by fingerprint and id together, so a class with many rows is no hot key.
    """
    columns = docs.columns
    wide = docs.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{text}`").alias("__text"), F.struct(*[f"`{c}`" for c in columns]).alias("__row"))
    printed = materialize(fingerprints(wide, ["__doc", "__row"], "__text"), "printed")
    found = classes(printed, "__doc", distance, blocks).select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), "component_id")
    leaders = printed.join(found, (printed["fp"] == F.col("__fp")) & printed["__doc"].eqNullSafe(F.col("component_id")))
    return leaders.groupBy("__root").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
