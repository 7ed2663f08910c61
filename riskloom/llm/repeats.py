"""Removes repeated byte strings by longest-previous-factor arrays over suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in an earlier document, or earlier in
the same one).  Every start of such a string (a window) is owned by one anchor: the least hash among
the short substrings inside the window.  Equal windows have equal anchors, so only anchors seen twice matter.
Copies of an anchor whose owned bytes are equal fold to the first; what differs is brought together by anchor
as text, its suffixes are sorted, and the longest-previous-factor array tells the windows with an earlier match.
Of an anchor with very many different copies only digests of windows move, and the first place of each is a minimum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_wise, text_bytes
from riskloom.llm.decontaminate import _powers
from riskloom.session import materialize

_R = 0xC6BC279692B5CC83 | 1
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Anchors:
    """Anchors of byte buffers for windows of ``length`` bytes and substrings of ``seed`` bytes."""

    SLICE = 1 << 20

    def __init__(self, length: int, seed: int) -> None:
        self.length, self.seed = length, seed
        n = self.SLICE + length + 1
        self.up, self.down = _powers(_R, n), _powers(pow(_R, -1, 2**64), n)

    def of(self, text: bytes):
        """(key, owned hash, anchor's offset, first window, windows) of each anchor; long texts go by slices of windows."""
        parts = []
        for a in range(0, len(text) - self.length + 1, self.SLICE):
            key, own, at, first, n = self._of(np.frombuffer(text[a : a + self.SLICE + self.length - 1], np.uint8))
            parts.append((key, own, at + a, first + a, n))
        return tuple(map(np.concatenate, zip(*parts)))

    def _of(self, raw: np.ndarray):
        n, k, length = len(raw), self.seed, self.length
        sums = np.zeros(n + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * self.up[:n], out=sums[1:])
        h = _mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        bits = int(n).bit_length()
        low = _U((1 << bits) - 1)
        best = (h & ~low) | np.arange(len(h), dtype=_U)
        width, have = length - k + 1, 1
        while have < width:
            step = min(have, width - have)
            best = np.minimum(best[:-step], best[step:])
            have += step
        at = (best & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        at = at[first]
        end = first + count - 1 + length
        own = _mix((sums[end] - sums[first]) * self.down[first] + (at - first).astype(_U) * _U(0x9E3779B97F4A7C15) + count.astype(_U))
        return h[at].view(np.int64), own.view(np.int64), at, first, count


def _words(text: np.ndarray, length: int):
    """Function of (starts, j): the j-th eight of the ``length`` bytes from each start, as numbers in byte order."""
    count = -(-length // 8)
    padded = np.concatenate([text, np.zeros(8 * count + 8, np.uint8)])
    at = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    spare = _U(8 * (8 * count - length))

    def word(starts: np.ndarray, j: int) -> np.ndarray:
        w = at[starts + 8 * j].astype(_U)
        return w >> spare << spare if j == count - 1 else w

    return word, count


def _recurring(text: np.ndarray, starts: np.ndarray, length: int):
    """(index of the first start of each string of ``length`` bytes that starts twice or more, those of its other starts)."""
    word, count = _words(text, length)
    h = np.zeros(len(starts), _U)
    for j in range(count):
        h = _mix((h + _U(1)) * _U(_R) ^ word(starts, j))
    order = np.argsort(h)
    new = np.concatenate([[True], np.diff(h[order]) != 0, [True]])
    order = order[~(new[:-1] & new[1:])]
    if not len(order):
        return order, order
    fresh = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    least = np.minimum.reduceat(order, fresh)
    of = np.repeat(least, np.diff(np.append(fresh, len(order))))
    if all(np.array_equal(word(starts[order], j), word(starts[of], j)) for j in range(count)):
        return least, order[order != of]
    return order, order[:0]  # two strings of one hash: the suffix order tells them


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int):
    """(order, shared): ``starts`` by the ``length`` bytes from each, ties by place, and bytes shared with the one before (0 for the first)."""
    word, count = _words(text, length)
    order = np.argsort(word(starts, 0), kind="stable")
    first = word(starts[order], 0)
    tied = np.concatenate([[False], first[1:] == first[:-1]])
    shared = np.zeros(len(starts), np.int64)
    shared[1:] = _agree(first)
    for j in range(1, count):
        if not tied.any():
            break
        live = np.flatnonzero(tied | np.append(tied[1:], False))
        group = np.cumsum(~tied[live])
        w = word(starts[order[live]], j)
        by = np.lexsort((w, group))
        order[live] = order[live][by]
        w = w[by]
        still = tied[live[1:]]
        at = live[1:][still]
        same = _agree(w)[still]
        shared[at] = np.minimum(8 * j + same, length)
        tied[at] = same == 8
    return order, shared


def _agree(w: np.ndarray) -> np.ndarray:
    """Leading bytes that each number shares with the one before it."""
    differ = w[1:] ^ w[:-1]
    return sum((differ < _U(1 << 8 * k)).astype(np.int64) for k in range(8))  # the last is that of equal numbers


def longest_previous_factors(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the earlier suffix most like it, from the suffix order.

    That one is the previous or the next of smaller place in suffix order; one pass with a stack finds both.
    """
    out = np.zeros(len(order), np.int64)
    places, alike = [], []
    for place, low in zip([*order.tolist(), -1], [*shared.tolist(), 0]):
        while places and places[-1] > place:
            top = alike.pop()
            out[places.pop()] = top if top > low else low
            if top < low:
                low = top
        places.append(place)
        alike.append(low)
    return out


def previous_factors(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Longest-previous-factor array over the suffixes from ``starts``, at most ``length``.

    ``starts`` ascend in the order in which the suffixes count as earlier, and each has ``length`` bytes before
    its end.  Suffixes whose ``length`` bytes start nowhere else can't reach that value; they stand at 0 and the others are
    compared among each other.  Of suffixes that agree on all of these bytes, each has the one before it as its previous smaller
    position; the first of each are put in suffix order.
    """
    out = np.zeros(len(starts), np.int64)
    first, later = _recurring(text, starts, length)
    if len(first):
        out[later] = length
        first = np.sort(first)
        out[first] = longest_previous_factors(*suffix_order(text, starts[first], length))
    return out


def _ids_of(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, bool]:
    """doc, tie, text, and whether ids repeat: ``tie`` orders rows that share an id and is 0 where ids are unique."""
    twice = docs.groupBy(F.col(doc).alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    tie = F.xxhash64(F.col(text)) if twice else F.lit(0).cast("long")
    return docs.select(F.col(doc).cast("long").alias("doc"), tie.alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text")), bool(twice)


def _anchor_rows(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """One row for each anchor: key, own, doc, tie, at (first window << 16 | offset of the anchor << 8 | windows)."""
    names = ["key", "own", "doc", "tie", "at"]

    def run(batches):
        anchors = Anchors(length, seed)
        for batch in batches:
            held, size = [], 0
            for doc, tie, text in zip(batch.column(0), batch.column(1), text_bytes(batch, "text")):
                if len(text) < length:
                    continue
                key, own, at, first, n = anchors.of(text)
                held.append((key, own, doc.as_py(), tie.as_py(), (first << 16) | ((at - first) << 8) | n))
                size += len(key)
                if size > 200_000:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    def packed(held):
        sizes = [len(h[0]) for h in held]
        repeat = lambda values: pa.array([v for v in values], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held])),
                                           repeat(h[2] for h in held), repeat(h[3] for h in held), pa.array(np.concatenate([h[4] for h in held]))], names=names)

    return rows.mapInArrow(run, "key long, own long, doc long, tie long, at long")


def _owned_text(length: int, most: int = 50_000):
    """Rows (key, doc, tie, at, bytes) of wanted anchors from (doc, tie, text, list of (key, at))."""
    def run(batches):
        for batch in batches:
            wanted = batch.column(3).flatten()
            key, at = wanted.field(0).to_numpy(), wanted.field(1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(3)).to_numpy())
            first, stop = at >> 16, (at >> 16) + (at & 255) - 1 + length
            data = text_bytes(batch, "text")
            for a in range(0, len(row), most):
                part = slice(a, a + most)
                found = [data[r][f:s] for r, f, s in zip(row[part].tolist(), first[part].tolist(), stop[part].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), batch.column(0).take(pa.array(row[part])), batch.column(1).take(pa.array(row[part])),
                                                  pa.array(at[part]), pa.array(found, pa.binary())], names=["key", "doc", "tie", "at", "bytes"])

    return run


def _window_digests(length: int):
    """Rows (digest, doc, tie, at) of each window of the wanted anchors, from the same input; digests have 128 bits of BLAKE2b."""
    names = ["digest", "doc", "tie", "at"]

    def run(batches):
        digest = hashlib.blake2b
        for batch in batches:
            for doc, tie, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch, "text"), batch.column(3).to_pylist()):
                at = [i for w in wanted for i in range(w["at"] >> 16, (w["at"] >> 16) + (w["at"] & 255))]
                for a in range(0, len(at), 100_000):
                    part = at[a : a + 100_000]
                    found = [digest(text[i : i + length], digest_size=16).digest() for i in part]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([doc] * len(part), pa.int64()), pa.array([tie] * len(part), pa.int64()),
                                                      pa.array([i << 16 | 1 for i in part], pa.int64())], names=names)

    return run


def _matched(length: int, most_bytes: int = 4_000_000):
    """(doc, tie, first, n) of windows with an earlier match, from owned text sorted by key, doc, tie and place.

    Whole groups are gathered until they fill a buffer, and one suffix order serves them all.
    """
    def flush(held):
        doc, tie, at, owned = (pa.concat_arrays([b.column(i) for b in held]) for i in (1, 2, 3, 4))
        offsets = np.frombuffer(owned.buffers()[1], np.int32)[owned.offset : owned.offset + len(owned) + 1].astype(np.int64)
        text = np.frombuffer(owned.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        begins = offsets[:-1] - offsets[0]
        counts = np.diff(offsets) - length + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = previous_factors(text, begins[owner] + offset, length) == length
        edge = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])]))
        stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]]))
        who = owner[edge]
        first = (at.to_numpy() >> 16)[who] + offset[edge]
        return pa.RecordBatch.from_arrays([doc.take(pa.array(who)), tie.take(pa.array(who)), pa.array(first), pa.array(stop - edge + 1)], names=["doc", "tie", "first", "n"])

    def run(batches):
        held, size, mark = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            before = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(4)).to_numpy().astype(np.int64))])
            fresh = np.flatnonzero(np.concatenate([[key[0] != mark], key[1:] != key[:-1]]))
            begin = 0
            while True:
                cut = fresh[(fresh >= begin) & (size + before[fresh] - before[begin] > most_bytes)][:1]
                end = int(cut[0]) if len(cut) else batch.num_rows
                held.append(batch.slice(begin, end - begin))
                size += int(before[end] - before[begin])
                if not len(cut):
                    break
                yield flush(held)
                held, size, begin = [], 0, end
            mark = key[-1]
        if held:
            yield flush(held)

    return run


def cut_ranges(text: bytes, marks, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text from marks (kind, first window, windows).

    Windows of kind 0 have an earlier match, except those of kind 1 (first copies), except those of kind 2 (matched by another).
    """
    n = len(text) - length + 1
    if n <= 0 or not len(marks):
        return []
    marks = np.asarray(marks, np.int64)

    def within(kind):
        _, first, count = marks[marks[:, 0] == kind].T
        return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(first + count, minlength=n + 1))[:n] > 0

    at = np.flatnonzero(within(0) & ~within(1) | within(2))
    if not len(at):
        return []
    apart = np.flatnonzero(np.diff(at) > length)  # the windows on both sides leave a byte between them
    return list(zip(at[np.append(0, apart + 1)].tolist(), (at[np.append(apart, len(at) - 1)] + length).tolist()))


def _of_keys(anchors: DataFrame, keys: DataFrame, least: int = 2_000, most_keys: int = 100_000) -> DataFrame:
    """Anchors of ``keys`` (k, n, mixed), with ``mixed``; those of a key with very many are dealt to several tasks.

    A key is heavy that has more than ``least`` anchors and more than one of ``most_keys`` parts of all, so there are at most ``most_keys``
    heavy keys, which are broadcast with their numbers of parts.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(least, total // most_keys)
    parts = F.when(F.col("n") > bound, F.ceil(F.col("n") / F.lit(bound)).cast("int")).otherwise(1)
    heavy = F.broadcast(keys.where(F.col("n") > bound).select(F.col("k").alias("h"), parts.alias("parts")))
    dealt = anchors.join(heavy, anchors["key"] == heavy["h"], "left").withColumn(
        "part", F.when(F.col("h").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "at"), F.col("parts")).cast("int")))
    spread = keys.select("k", "mixed", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p")).hint("shuffle_hash")
    return dealt.join(spread, (dealt["key"] == spread["k"]) & (dealt["part"] == spread["p"])).select("key", "own", "doc", "tie", "at", "mixed")


def repeated(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = 100, seed: int = 24, most_copies: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(documents, marks): rows (doc, tie, text) and lists of marks for ``cut_ranges`` by (doc, tie).

    Null ids come first; rows of equal id are ordered by text hash, and identical rows count as one document, so each
    of them keeps what the one keeps.  An anchor with up to ``most_copies`` different copies is compared as text in one
    task; of one with more, each window's digest keeps its least place, so no group of equal windows is gathered.
    """
    if not seed <= length <= seed + 254:
        raise ValueError("length must lie between seed and seed + 254: an anchor's windows are counted in 8 bits")
    rows, ties = _ids_of(docs, doc, text)
    distinct = rows.dropDuplicates(["doc", "tie"]) if ties else rows
    anchors = _anchor_rows(distinct, length, seed)
    keys = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("low"), F.max("own").alias("high")).where("n > 1")
    keys = materialize(keys.select(F.col("key").alias("k"), F.col("n"), (F.col("low") != F.col("high")).alias("mixed")), "keys")
    seen = materialize(_of_keys(anchors, keys), "anchors")
    place = F.struct("doc", "tie", "at")
    firsts = seen.groupBy("key", "own", "mixed").agg(F.min(place).alias("p")).select("key", "mixed", "p.doc", "p.tie", "p.at")
    firsts = materialize(firsts, "firsts")
    mixed = firsts.where("mixed")
    wide = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_copies).select(F.col("key").alias("k"), F.lit(True).alias("wide"))
    wide = materialize(wide, "wide")
    some_wide = bool(wide.limit(1).count())
    if some_wide:
        firsts = materialize(firsts.join(wide, firsts["key"] == wide["k"], "left").drop("k"), "dealt")
        mixed, wide = firsts.where("mixed and wide is null"), firsts.where("wide")

    def with_text(anchors):
        wanted = anchors.groupBy(F.col("doc").alias("d"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("key", "at")).alias("wanted"))
        return distinct.join(wanted, distinct["doc"].eqNullSafe(F.col("d")) & (distinct["tie"] == F.col("t"))).select("doc", "tie", "text", "wanted")

    owned = with_text(mixed).mapInArrow(_owned_text(length), "key long, doc long, tie long, at long, bytes binary")
    matched = owned.repartition("key").sortWithinPartitions("key", "doc", "tie", "at").mapInArrow(_matched(length), "doc long, tie long, first long, n long")
    if some_wide:
        windows = with_text(wide).mapInArrow(_window_digests(length), "digest binary, doc long, tie long, at long")
        least = windows.groupBy("digest").agg(F.min(place).alias("p")).select("p.doc", "p.tie", "p.at")
        firsts = firsts.where("wide is null").select("doc", "tie", "at").unionByName(least)
    spread = lambda df, kind: df.select("doc", "tie", F.struct(F.lit(kind).alias("kind"), F.shiftright("at", 16).alias("first"), F.col("at").bitwiseAND(255).alias("n")).alias("m"))
    marks = spread(seen, 0).unionByName(spread(firsts, 1)).unionByName(
        matched.select("doc", "tie", F.struct(F.lit(2).alias("kind"), "first", "n").alias("m")))
    return rows, marks.groupBy(F.col("doc").alias("d"), F.col("tie").alias("t")).agg(F.collect_list("m").alias("marks"))


FOUND = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def digest(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; a null or empty text loses nothing."""
    return kept(docs, doc, text, length).select(
        F.col("doc").alias("doc_id"), *FOUND)


def kept(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """doc, tie, the counts and digest of ``FOUND``, and ``kept``, the bytes that remain, of each row."""
    rows, marks = repeated(docs, doc, text, length)
    joined = rows.join(marks, rows["doc"].eqNullSafe(F.col("d")) & (rows["tie"] == F.col("t")), "left").select("doc", "tie", "text", "marks")

    def compute(batches):
        for batch in batches:
            out = []
            lists = batch.column(batch.schema.get_field_index("marks"))
            flat = np.stack([x.to_numpy().astype(np.int64) for x in lists.flatten().flatten()], axis=1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            for x, marks in zip(text_bytes(batch, "text"), np.split(flat, ends[:-1])):
                runs = cut_ranges(x, marks, length)
                rest, at = [], 0
                for a, b in runs:
                    rest.append(x[at:a])
                    at = b
                left = b"".join([*rest, x[at:]])
                out.append((len(x), len(x) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            yield [list(c) for c in zip(*out)] or [[] for _ in range(5)]

    carried = joined.select("doc", "tie", "marks", "text")
    return row_wise(carried, ["doc", "tie", "marks"], "text", {**FOUND, "kept": "binary"}, compute).drop("marks")
