"""Average-linkage clusters of a prompt's sample vectors, cut at a similarity.

With cosine similarity the mean over all pairs between two clusters is the dot
product of their summed unit vectors over the product of their sizes, so a
cluster is its size and its sum.  Equal vectors fold first and are kept as a
weight.  Prompts with few distinct vectors are clustered inside one Arrow batch
many at a time; the rest go through rounds that merge mutual nearest clusters,
which for average linkage gives the same tree without one task seeing the group.
In a round, prompts of one block are compared many to an Arrow batch.
Blocks around pivots bound the similarity of their members, so most pairs of blocks are never compared.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import CLUSTER_SIMILARITY
from riskloom.functions.vectors import unit
from riskloom.session import materialize

LOCAL_LIMIT = 256
BLOCK = 1024
# One rule for groups of any size: similarities are rounded, the threshold has a tolerance of that size, and of
# equally similar pairs the one with the smaller ids comes first.
DIGITS, TOLERANCE = 10, 1e-10


def close_enough(sim, threshold: float):
    return (1.0 - sim) <= (1.0 - threshold) + TOLERANCE


def link(units: np.ndarray, weights: np.ndarray, threshold: float) -> np.ndarray:
    """Index of each vector's cluster head after merging while distance <= 1 - threshold."""
    n = len(weights)
    head = np.arange(n)
    sums = units * weights[:, None]
    size = weights.astype(float).copy()
    sim = np.round((sums @ sums.T) / np.outer(size, size), DIGITS)
    np.fill_diagonal(sim, -np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(np.argmax(sim)), n)
        if not close_enough(sim[i, j], threshold):
            break
        i, j = min(i, j), max(i, j)
        sums[i] += sums[j]
        size[i] += size[j]
        head[head == j] = i
        sim[j, :] = sim[:, j] = -np.inf
        row = np.round((sums @ sums[i]) / (size * size[i]), DIGITS)
        gone = np.isneginf(sim[i])
        gone[i] = True
        row[gone] = -np.inf
        sim[i, :] = sim[:, i] = row
    return head


@F.pandas_udf(T.ArrayType(T.LongType()))
def _link_batch(reps: pd.Series, weights: pd.Series, flat: pd.Series, threshold: pd.Series) -> pd.Series:
    out = []
    for r, w, u, t in zip(reps, weights, flat, threshold):
        if r is None:
            out.append(None)
            continue
        r, w = np.asarray(r), np.asarray(w, dtype=float)
        out.append(r[link(np.asarray(u, dtype=float).reshape(len(r), -1), w, t)])
    return pd.Series(out)


def distinct_points(vectors: DataFrame) -> DataFrame:
    """prompt_id, vector, zero_key, rep, weight: each distinct vector of a prompt once.

    All-zero vectors resemble nothing, not even each other, so they stay apart.
    """
    zero = ~F.exists("vector", lambda x: x != 0)
    return vectors.withColumn("zero_key", F.when(zero, F.col("sample_id")).otherwise(F.lit(-1))) \
        .groupBy("prompt_id", "vector", "zero_key") \
        .agg(F.min("sample_id").cast("bigint").alias("rep"), F.count("*").alias("weight"))


def _cluster_small(points: DataFrame, threshold: float) -> DataFrame:
    """Prompts of at most ``LOCAL_LIMIT`` points, gathered into arrays of that size."""
    item = F.struct("rep", "weight", unit(F.col("vector")).alias("u"))
    per = points.groupBy("prompt_id").agg(F.sort_array(F.collect_list(item)).alias("_p"))
    several = F.size("_p") > 1
    heads = F.coalesce(
        _link_batch(F.when(several, F.col("_p.rep")), F.when(several, F.col("_p.weight")),
                    F.when(several, F.flatten("_p.u")), F.lit(threshold)),
        F.col("_p.rep"))
    return per.select("prompt_id", F.explode(F.arrays_zip(F.col("_p.rep").alias("rep"), heads.alias("cluster_id"))).alias("_z")) \
        .select("prompt_id", "_z.rep", "_z.cluster_id")


def _pivoted(state: DataFrame, block: int) -> DataFrame:
    """``state`` with ``blk``: clusters of a block lie near one pivot, and a block has about ``block`` of them.

    Pivots are drawn by a hash, about one for each block.  Every task takes one salt of a prompt's clusters and
    all its pivots, so the clusters move once and a group is bounded by the draw.
    """
    sizes = state.groupBy("prompt_id").agg(F.count("*").alias("_n"))
    counted = state.join(sizes, "prompt_id").withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("_nb")).cast("int"))
    drawn = counted.filter((F.pmod(F.xxhash64("cid", F.lit(1)), F.col("_n")) < F.col("_nb")) & (F.col("_nb") > 1))
    pivots = drawn.select(*[F.col(c).alias(c) for c in ("prompt_id", "cid", "w", "usum")], F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("salt"))
    kind = state.schema["prompt_id"].dataType.simpleString()

    def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = rows[["prompt_id", "cid", "w", "usum"]].copy()
        out["pivot"] = -1
        if len(near) and len(rows):
            near = near.sort_values("cid")
            means = np.stack(near["usum"]) / near["w"].to_numpy()[:, None]
            means /= np.maximum(np.linalg.norm(means, axis=1), 1e-300)[:, None]
            out["pivot"] = near["cid"].to_numpy()[(np.stack(rows["usum"]) @ means.T).argmax(axis=1)]
        return out

    found = salted.groupBy("prompt_id", "salt").cogroup(pivots.groupBy("prompt_id", "salt")).applyInPandas(
        assign, f"prompt_id {kind}, cid bigint, w double, usum array<double>, pivot bigint")
    found = materialize(found, "pivoted")
    parts = found.groupBy("prompt_id", "pivot").agg(F.ceil(F.count("*") / block).alias("_parts"))
    return found.join(parts, ["prompt_id", "pivot"]).select(
        "prompt_id", "cid", "w", "usum", F.xxhash64("pivot", F.pmod(F.xxhash64("cid"), F.col("_parts"))).alias("blk"))


def _block_pairs(dealt: DataFrame, threshold: float) -> DataFrame:
    """Pairs (i, j) of a prompt's blocks that can hold a pair of clusters within the threshold.

    With c the middle of a block's means and r their largest distance from it, two means have at most the
    dot product c c' + |c| r' + |c'| r + r r', so blocks below the threshold by that bound are never compared.
    """
    kind = dealt.schema["prompt_id"].dataType.simpleString()

    def ball(pdf: pd.DataFrame) -> pd.DataFrame:
        means = np.stack(pdf["usum"]) / pdf["w"].to_numpy()[:, None]
        centre = means.mean(axis=0)
        return pd.DataFrame({"prompt_id": pdf["prompt_id"].iloc[:1], "blk": pdf["blk"].iloc[:1], "c": [centre],
                             "r": [float(np.linalg.norm(means - centre, axis=1).max())], "size": [float(np.linalg.norm(centre))]})

    balls = materialize(dealt.groupBy("prompt_id", "blk").applyInPandas(
        ball, f"prompt_id {kind}, blk bigint, c array<double>, r double, size double"), "balls")
    one = balls.select("prompt_id", F.col("blk").alias("i"), F.col("c").alias("ci"), F.col("r").alias("ri"), F.col("size").alias("si"))
    two = balls.select("prompt_id", F.col("blk").alias("j"), F.col("c").alias("cj"), F.col("r").alias("rj"), F.col("size").alias("sj"))
    dot = F.aggregate(F.zip_with("ci", "cj", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    bound = dot + F.col("si") * F.col("rj") + F.col("sj") * F.col("ri") + F.col("ri") * F.col("rj")
    return one.join(two, "prompt_id").filter((F.col("i") == F.col("j")) | (bound >= threshold - 2 * TOLERANCE)).select("prompt_id", "i", "j")


def _nearest(state: DataFrame, block: int, threshold: float) -> DataFrame:
    """Most similar other cluster of each cluster that has one within the threshold: prompt_id, cid, best, sim.

    Prompts of one block are compared many at a time; only larger ones are dealt into blocks.
    """
    large = materialize(state.groupBy("prompt_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("prompt_id"), "large")
    if large.isEmpty():
        found = _nearest_whole(state, threshold)
    else:
        found = _nearest_whole(state.join(large, "prompt_id", "left_anti"), threshold) \
            .unionByName(_nearest_blocks(state.join(large, "prompt_id", "left_semi"), block, threshold))
    return found.groupBy("prompt_id", "cid").agg(
        F.max_by(F.struct("best", "sim"), F.struct(F.col("sim"), -F.col("best"))).alias("_b")) \
        .select("prompt_id", "cid", "_b.best", "_b.sim")


def _nearest_in(w: np.ndarray, cid: np.ndarray, begins: np.ndarray, flat: np.ndarray, at: np.ndarray, widths: np.ndarray,
                threshold: float, most: int = 2_000_000):
    """(row, row of its nearest, similarity) for rows of prompts that begin at ``begins``; a row's sum is ``flat`` from ``at`` on.

    Prompts of equal size are compared in one array of at most about ``most`` numbers.
    """
    sizes = np.diff(np.append(begins, len(w)))
    if (np.repeat(widths[begins], sizes) != widths).any():
        raise ValueError("the vectors of a prompt differ in length")
    shapes = np.stack([sizes, widths[begins]], 1)
    for n, d in np.unique(shapes[sizes > 1], axis=0).tolist():
        alike = begins[(shapes == (n, d)).all(1)]
        step = max(1, most // (n * max(n, d)))
        for a in range(0, len(alike), step):
            rows = alike[a : a + step, None] + np.arange(n)
            sums, weights, names = flat[at[rows][:, :, None] + np.arange(d)], w[rows], cid[rows]
            sim = np.round((sums @ sums.transpose(0, 2, 1)) / (weights[:, :, None] * weights[:, None, :]), DIGITS)
            sim[names[:, :, None] == names[:, None, :]] = -np.inf
            best = sim.argmax(axis=2)
            top = np.take_along_axis(sim, best[:, :, None], 2)[:, :, 0]
            on = close_enough(top, threshold)
            yield rows[on], np.take_along_axis(rows, best, 1)[on], top[on]


def _nearest_whole(state: DataFrame, threshold: float) -> DataFrame:
    """Candidates of clusters whose prompts are one block each.

    A prompt's clusters lie in a row in one task; a batch holds many prompts, and no more than one is carried over to the next.
    """
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        rest = None
        for batch in chain(batches, [None]):  # None: there are no more, so that what is left is whole
            parts = [] if rest is None else [rest]
            if batch is not None:
                parts.append(pa.Table.from_batches([batch]))
            if not parts:
                continue
            rows = pa.concat_tables(parts).combine_chunks()
            codes = rows["prompt_id"].combine_chunks().dictionary_encode().indices.to_numpy()
            begins = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            if batch is not None:
                rows, rest, begins = rows.slice(0, begins[-1]), rows.slice(begins[-1]), begins[:-1]
            if not rows.num_rows:
                continue
            sums = rows["usum"].combine_chunks()
            if sums.null_count:
                raise ValueError("a cluster has no vector")
            widths = pc.list_value_length(sums).to_numpy().astype(np.int64)
            for mine, other, sim in _nearest_in(rows["w"].to_numpy(), rows["cid"].to_numpy(), begins, sums.flatten().to_numpy(zero_copy_only=False),
                                                np.cumsum(widths) - widths, widths, threshold):
                taken = [rows[c].take(pa.array(i)).combine_chunks() for c, i in (("prompt_id", mine), ("cid", mine), ("cid", other))]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(sim)], names=["prompt_id", "cid", "best", "sim"])

    kind = state.schema["prompt_id"].dataType.simpleString()
    ordered = state.select("prompt_id", "cid", "w", "usum").repartition("prompt_id").sortWithinPartitions("prompt_id", "cid")
    return ordered.mapInArrow(run, f"prompt_id {kind}, cid bigint, best bigint, sim double")


def _nearest_blocks(state: DataFrame, block: int, threshold: float) -> DataFrame:
    """Candidates of clusters of large prompts, at most one for each block its own is compared with.

    Clusters are dealt into blocks around pivots; a task compares two blocks that may hold a close pair
    and keeps one candidate per cluster, so no list of pairs is ever produced.
    """
    dealt = materialize(_pivoted(state, block), "dealt")
    pairs = materialize(_block_pairs(dealt, threshold), "block-pairs")
    mine = dealt.withColumnRenamed("blk", "i").join(pairs, ["prompt_id", "i"])
    others = dealt.withColumnRenamed("blk", "j").join(pairs, ["prompt_id", "j"])
    names = ["prompt_id", "i", "j", "cid", "w", "usum"]
    left = mine.select(*names, F.lit(True).alias("mine"))
    right = others.select(*names, F.lit(False).alias("mine"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["mine"]], pdf[~pdf["mine"]].sort_values("cid")
        if a.empty or b.empty:
            return pd.DataFrame({"prompt_id": [], "cid": [], "best": [], "sim": []})
        sim = np.stack(a["usum"]) @ np.stack(b["usum"]).T
        sim = np.round(sim / np.outer(a["w"], b["w"]), DIGITS)
        sim[a["cid"].to_numpy()[:, None] == b["cid"].to_numpy()[None, :]] = -np.inf
        at = sim.argmax(axis=1)
        out = pd.DataFrame({"prompt_id": a["prompt_id"].to_numpy(), "cid": a["cid"].to_numpy(),
                            "best": b["cid"].to_numpy()[at], "sim": sim[np.arange(len(at)), at]})
        return out[close_enough(out["sim"], threshold)]

    kind = state.schema["prompt_id"].dataType.simpleString()
    return left.unionByName(right).groupBy("prompt_id", "i", "j").applyInPandas(
        compare, f"prompt_id {kind}, cid bigint, best bigint, sim double")


def _cluster_large(points: DataFrame, threshold: float, block: int) -> DataFrame:
    """Merge mutual nearest clusters until none is similar enough.

    Each round is written to the shared folder, which cuts the lineage.
    """
    u = unit(F.col("vector"))
    state = materialize(points.select("prompt_id", F.col("rep").alias("cid"), F.col("weight").cast("double").alias("w"),
                                      F.transform(u, lambda x: x * F.col("weight")).alias("usum")), "clusters")
    members = materialize(points.select("prompt_id", "rep", F.col("rep").alias("cluster_id")), "members")
    while True:
        near = materialize(_nearest(state, block, threshold), "nearest")
        back = near.select("prompt_id", F.col("cid").alias("best"), F.col("best").alias("cid"))
        merges = near.join(back, ["prompt_id", "cid", "best"]).filter(F.col("cid") < F.col("best")) \
            .select("prompt_id", F.col("best").alias("gone"), F.col("cid").alias("into"))
        merges = materialize(merges, "merges")
        if merges.isEmpty():
            if near.isEmpty():
                return members
            raise RuntimeError("clusters within the threshold are left, but no pair is mutually nearest")
        # a prompt without a close pair is done
        state = state.join(near.select("prompt_id").distinct(), "prompt_id", "left_semi")
        moved = state.join(merges.withColumnRenamed("gone", "cid"), ["prompt_id", "cid"])
        gain = moved.select("prompt_id", F.col("into").alias("cid"), F.col("w").alias("w2"), F.col("usum").alias("u2"))
        kept = state.join(merges.select("prompt_id", F.col("gone").alias("cid")), ["prompt_id", "cid"], "left_anti")
        state = materialize(kept.join(gain, ["prompt_id", "cid"], "left").select(
            "prompt_id", "cid", (F.col("w") + F.coalesce("w2", F.lit(0.0))).alias("w"),
            F.when(F.col("u2").isNull(), F.col("usum")).otherwise(
                F.zip_with("usum", "u2", lambda a, b: a + b)).alias("usum")), "clusters")
        members = materialize(members.join(merges.withColumnRenamed("gone", "cluster_id"), ["prompt_id", "cluster_id"], "left")
                              .select("prompt_id", "rep", F.coalesce("into", "cluster_id").alias("cluster_id")), "members")


def cluster_points(points: DataFrame, threshold: float = CLUSTER_SIMILARITY,
                   local_limit: int = LOCAL_LIMIT, block: int = BLOCK) -> DataFrame:
    """prompt_id, rep, cluster_id for the table of ``distinct_points``."""
    sizes = points.groupBy("prompt_id").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > local_limit).select("prompt_id")
    if large.isEmpty():
        return _cluster_small(points, threshold)
    small = _cluster_small(points.join(large, "prompt_id", "left_anti"), threshold)
    return small.unionByName(_cluster_large(points.join(large, "prompt_id", "left_semi"), threshold, block))


def cluster_samples(vectors: DataFrame, threshold: float = CLUSTER_SIMILARITY,
                    local_limit: int = LOCAL_LIMIT, block: int = BLOCK) -> DataFrame:
    """prompt_id, sample_id, cluster_id; a cluster is named by its smallest sample id.

    Reads prompt_id, sample_id, vector.  The distinct vectors are written to the
    shared folder once, since counting and clustering both need them.
    """
    points = materialize(distinct_points(vectors), "points")
    heads = cluster_points(points, threshold, local_limit, block)
    named = points.join(heads, ["prompt_id", "rep"]).select("prompt_id", "vector", "zero_key", "cluster_id")
    zero = ~F.exists("vector", lambda x: x != 0)
    keyed = vectors.withColumn("zero_key", F.when(zero, F.col("sample_id")).otherwise(F.lit(-1)))
    return keyed.join(named, ["prompt_id", "vector", "zero_key"]).select("prompt_id", "sample_id", "cluster_id")


def cluster_weights(vectors: DataFrame, threshold: float = CLUSTER_SIMILARITY,
                    local_limit: int = LOCAL_LIMIT, block: int = BLOCK) -> DataFrame:
    """prompt_id, cluster_id, weight per distinct vector; enough for the entropy, no join back."""
    points = materialize(distinct_points(vectors), "points")
    heads = cluster_points(points, threshold, local_limit, block)
    return points.select("prompt_id", "rep", "weight").join(heads, ["prompt_id", "rep"]) \
        .select("prompt_id", "cluster_id", "weight")
