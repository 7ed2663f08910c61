"""Ranked lexical search by pipelined term partitioning.

Query terms are dealt to owners, rare terms first.  Bundles of items pass the owners in turn: at each one a
bundle's accumulators, sparse (item, document) sums, are cogrouped with the owner's postings, which add their
integer contributions.  After each stage the 20th best sum so far bounds an item's final 20th from below, and
sums that the terms still to come can't lift that far are dropped; that loses no result.  Documents are dealt in
blocks, so a stage holds one bundle over one block at a time however frequent a term is.
"""

from __future__ import annotations

import math
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import SLICE, slices, text_bytes
from riskloom.session import drop_stage, materialize

#: Letters and digits, A-Z lowered, and bytes from 0x80 on stay; every other byte ends a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents of a block are at most 1 << BLOCK_BITS.
BLOCK_BITS = 11
BUNDLE = 512
#: Owners hold the terms that at most this share of documents has; the last one holds the rest.
SHARES = (1 / 1024, 1 / 64)
#: Rows (item, term) that are broadcast at once; larger sets of items run in several passes.
MOST_ITEM_TERMS = 2_000_000

_SUMS = "block long, bundle int, item int, row long, doc long, score long"
_SHARES = "block long, bundle int, row long, doc long, m long, terms array<int>, tfs array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, q): how often each item has each of its terms."""
    def run(batches):
        for batch in batches:
            rows = []
            for item, x in zip(batch.column(0).to_pylist(), text_bytes(batch, "text")):
                counts: dict[bytes, int] = {}
                for t in terms_of(x):
                    counts[t] = counts.get(t, 0) + 1
                rows += [(item, t, q) for t, q in counts.items()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())],
                                             names=["item", "term", "q"])

    return items.select("item", "text").mapInArrow(run, "item long, term binary, q long")


def _postings(docs: DataFrame, doc: str, text: str, vocabulary) -> DataFrame:
    """(doc, n, terms, tfs) of each row with a term: all its terms counted, those of the vocabulary listed."""
    def run(batches):
        known = vocabulary.value
        size, get = max(1, len(known)), known.get
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                parts = [terms_of(x) for x in text_bytes(batch, "text")]
                n = np.array([len(p) for p in parts], np.int64)
                ids = np.fromiter(map(get, chain.from_iterable(parts), repeat(-1)), np.int64, int(n.sum()))
                owner = np.repeat(np.arange(len(n)), n)
                code, tf = np.unique((owner * size + ids)[ids >= 0], return_counts=True)
                at = pa.array(np.searchsorted(code, np.arange(len(n) + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (code % size, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>").withColumn("row", F.monotonically_increasing_id())


class Query:
    """What every stage needs of the items of a pass; its size is bounded by MOST_ITEM_TERMS."""

    def __init__(self, rows, terms: list[bytes], df: np.ndarray, most: np.ndarray, n_docs: int) -> None:
        """rows: (item, term, q); df and most: documents and largest impact of each term."""
        place = {t: i for i, t in enumerate(terms)}
        order = sorted((place[bytes(t)], item, q) for item, t, q in rows)
        self.term, self.item, self.q = (np.array(c, np.int64) for c in zip(*order))
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        self.owner = np.searchsorted(np.array(SHARES) * n_docs, df)
        self.n_items, self.n_owners = int(self.item.max()) + 1, len(SHARES) + 1
        #: What the terms of owners from s on can add to an item at most.
        self.ahead = np.zeros((self.n_owners + 1, self.n_items), np.int64)
        for s in range(self.n_owners - 1, -1, -1):
            own = self.owner[self.term] == s
            np.add.at(self.ahead[s], self.item[own], (self.q * (self.weight * most)[self.term])[own])
            self.ahead[s] += self.ahead[s + 1]

    def bundles(self) -> range:
        return range(-(-self.n_items // BUNDLE))

    def has(self, stage: int, bundle: int) -> np.ndarray:
        """Whether each term is of that owner and of an item of that bundle."""
        out = np.zeros(len(self.owner), bool)
        out[self.term[self.item // BUNDLE == bundle]] = True
        return out & (self.owner == stage)


def _owned(postings: DataFrame, query, stage: int) -> DataFrame:
    """The postings that the bundles need of one owner, a row for each document and bundle."""
    def run(batches):
        q = query.value
        wanted = [(b, q.has(stage, b)) for b in q.bundles()]
        for batch in batches:
            terms, tfs = batch.column(3), batch.column(4)
            flat, counts = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            owner = np.repeat(np.arange(len(batch)), terms.value_lengths().to_numpy())
            for bundle, has in wanted:
                keep = has[flat]
                n = np.bincount(owner[keep], minlength=len(batch))
                at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v[keep], pa.int32())) for v in (flat, counts)]
                row = batch.column(0)
                out = [pa.array(row.to_numpy() >> BLOCK_BITS), pa.array(np.full(len(batch), bundle, np.int32)), row, batch.column(1), batch.column(2), *lists]
                yield pa.RecordBatch.from_arrays(out, names=["block", "bundle", "row", "doc", "m", "terms", "tfs"]).filter(pa.array(n > 0))

    return postings.select("row", "doc", "m", "terms", "tfs").mapInArrow(run, _SHARES)


def _visit(query, stage: int, bounds, best: int):
    """One bundle over one block at one owner."""
    def run(sums: pa.Table, shares: pa.Table) -> pa.Table:
        q = query.value
        some = sums if len(sums) else shares
        block, bundle = some["block"][0].as_py(), some["bundle"][0].as_py()
        begin = bundle * BUNDLE
        n_items = min(BUNDLE, q.n_items - begin)
        rows = pa.concat_arrays([c for t in (sums, shares) for c in t["row"].chunks])
        docs = pa.concat_arrays([c for t in (sums, shares) for c in t["doc"].chunks])
        rows, first = np.unique(rows.to_numpy(zero_copy_only=False), return_index=True)
        docs = docs.take(pa.array(first))
        total = np.zeros((n_items, len(rows)), np.int64)
        total[sums["item"].to_numpy() - begin, np.searchsorted(rows, sums["row"].to_numpy())] = sums["score"].to_numpy()
        if len(shares):
            terms, tfs = shares["terms"].combine_chunks(), shares["tfs"].combine_chunks()
            size = terms.value_lengths().to_numpy()
            term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            at = np.repeat(np.searchsorted(rows, shares["row"].to_numpy()), size)
            add = q.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(shares["m"].to_numpy(), size)))
            order = np.argsort(term, kind="stable")
            term, at, add = term[order], at[order], add[order]
            ends = np.concatenate([np.flatnonzero(np.diff(term)) + 1, [len(term)]])
            start = 0
            for end in ends.tolist():
                a, b = np.searchsorted(q.term, [term[start], term[start] + 1])
                items, times = q.item[a:b] - begin, q.q[a:b]
                mine = (items >= 0) & (items < n_items)
                total[np.ix_(items[mine], at[start:end])] += times[mine, None] * add[start:end]
                start = end
        bound = np.maximum(bounds.value[begin : begin + n_items], 1)
        if len(rows) >= best:
            bound = np.maximum(bound, np.partition(total, len(rows) - best, axis=1)[:, len(rows) - best])
        ahead = q.ahead[stage + 1, begin : begin + n_items]
        item, at = np.nonzero((total > 0) & (total + ahead[:, None] >= bound[:, None]))
        score = total[item, at]
        if stage == q.n_owners - 1:
            held = docs.is_null().to_numpy(zero_copy_only=False)
            ids = docs.fill_null(0).to_numpy()
            order = np.lexsort((rows[at], ids[at], held[at], -score, item))
            item, at, score = item[order], at[order], score[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            item, at, score = (x[rank < best] for x in (item, at, score))
        return pa.Table.from_arrays(
            [pa.array(np.full(len(item), block, np.int64)), pa.array(np.full(len(item), bundle, np.int32)), pa.array((item + begin).astype(np.int32)),
             pa.array(rows[at]), docs.take(pa.array(at)), pa.array(score)], names=["block", "bundle", "item", "row", "doc", "score"])

    return run


def _lower_bounds(sums: DataFrame, n_items: int, best: int) -> np.ndarray:
    """The least of the ``best`` largest sums of each item that has as many; Spark cuts to them before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    cut = sums.select("item", "score").withColumn("rank", rank).where(F.col("rank") <= best)
    out = np.zeros(n_items, np.int64)
    for item, score in cut.where(F.col("rank") == best).select("item", "score").collect():
        out[item] = score
    return out


def _search(docs: DataFrame, rows: list, doc: str, text: str, best: int) -> DataFrame | None:
    """(item, rank, doc, score) for the items of ``rows``: (item, term, q)."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    terms = sorted({bytes(t) for _, t, _ in rows})
    vocabulary = context.broadcast({t: i for i, t in enumerate(terms)})
    read = materialize(_postings(docs, doc, text, vocabulary), "postings")
    n_docs, n_terms = read.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    m = F.expr(f"100 - 25 + cast((25 * cast(n as decimal(20, 0)) * {n_docs}BD) div {n_terms}BD as bigint)")
    postings = read.withColumn("m", m)
    listed = postings.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("m", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)")
    df, most = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for t, n, x in listed.groupBy("term").agg(F.count(F.lit(1)), F.max(impact)).collect():
        df[t], most[t] = n, x
    plan = Query(rows, terms, df, most, n_docs)
    query, bounds = context.broadcast(plan), np.zeros(plan.n_items, np.int64)
    sums = spark.createDataFrame([], _SUMS)
    for stage in range(plan.n_owners):
        owned = _owned(postings, query, stage)
        visited = sums.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle")).applyInArrow(
            _visit(query, stage, context.broadcast(bounds), best), _SUMS)
        last, sums = sums, materialize(visited, "sums")
        drop_stage(last)
        if stage < plan.n_owners - 1:
            bounds = np.maximum(bounds, _lower_bounds(sums, plan.n_items, best))
    drop_stage(read)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("row")]
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= best).select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           best: int = 20) -> DataFrame:
    """``item``, rank, ``doc`` and score of each item's ``best`` documents with score above 0; equal scores by ascending id.

    Null, empty and termless texts rank nowhere, and such items find nothing.  Every row of ``items`` is an item
    of its own, also where ids repeat or are null, and every row of ``docs`` is a document; those of equal score and id come in
    the order of the rows, null ids last.  An empty table on either side gives no rows.  Other columns may have any name.
    """
    spark: SparkSession = docs.sparkSession
    asked = materialize(items.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{item}`").alias("id"), F.col(f"`{item_text}`").alias("text")), "items")
    terms = materialize(_item_terms(asked.select(F.col("number").alias("item"), "text")), "item-terms")
    passes = -(-terms.count() // MOST_ITEM_TERMS)
    out = None
    for k in range(passes):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).collect()
        places = {x: i for i, x in enumerate(sorted({r["item"] for r in mine}))}
        found = _search(docs, [(places[r["item"]], r["term"], r["q"]) for r in mine], doc, text, best) if mine else None
        if found is not None:
            numbers = spark.createDataFrame([(i, x) for x, i in places.items()], "item int, number long")
            found = found.join(numbers, "item").select("number", "rank", "doc", "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "number long, rank int, doc long, score long")
    named = out.join(asked.select("number", F.col("id").alias("__id")), "number")
    return named.select(F.col("__id").alias(item), "rank", F.col("doc").alias(doc), "score")
