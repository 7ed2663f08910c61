"""Alignment of two tokenizations of the same bytes, and corpus counts of the token pairs that meet.

A batch holds many documents at once.  One state vector keeps, for each of its lanes, a place among the tokens of either
side; every step emits one link a lane, advances the side whose token ends first (both at a cut) and
drops the lanes that are done.  A document is one lane or, if long, several in a row, parted at single spaces between
solid characters, where both encodings end a token.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_wise, text_bytes
from riskloom.llm.pieces import piece_pattern
from riskloom.llm.token_files import byte_letters
from riskloom.session import materialize

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a lane, about.
LANE = 1024
#: Token pairs whose counts are broadcast, the most frequent first; documents get the others by a join.
MOST_PAIRS = 2_000_000
#: Chunks whose ids a worker keeps.
MOST_CHUNKS = 250_000


class Sides:
    """Both tokenizers behind one cache of chunks: the byte-level one (A), and the one of pieces (B).

    A chunk starts behind a space, and no token of either side crosses its edges.
    """

    def __init__(self, spec: str, pattern: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        vocabulary = json.loads(spec)["model"]["vocab"]
        self.letters = byte_letters()
        back = {v: k for k, v in self.letters.items()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in back for c in token):
                self.a_bytes[i] = bytes(back[c] for c in token)
        self.tokenize = Tokenizer.from_str(spec).model.tokenize
        self.cut = piece_pattern(pattern).findall
        self.b = SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        #: A piece with a space behind another character would cross chunks.
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.chunks: dict[str, tuple[bytes, bytes] | None] = {}
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        out = self.known.get(piece)
        if out is None:
            letters = piece.encode().decode("latin-1").translate(self.letters)
            out = self.known[piece] = np.array([t.id for t in self.tokenize(letters)], "<u4").tobytes()
        return out

    def _learn(self, new: list[str]) -> None:
        left = [b"".join(map(self._piece, self.cut(" " + c))) for c in new]
        right = [np.array(x, "<u4").tobytes() for x in self.b.encode(new, num_threads=1)]
        self.chunks.update(zip(new, zip(left, right)))

    def encode(self, data: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of either side, as bytes, of a space and each text."""
        if not self.apart:
            return [(b"".join(map(self._piece, self.cut(" " + x))), np.array(self.b.encode(x), "<u4").tobytes()) for x in data]
        for cache in (self.chunks, self.known):
            if len(cache) > MOST_CHUNKS:
                kept = dict(islice(cache.items(), MOST_CHUNKS // 2))
                cache.clear()
                cache.update(kept)
        parts = [x.split(" ") for x in data]
        new = set().union(*parts).difference(self.chunks)
        odd = [c for c in new if not c or c[0].isspace() or c[-1].isspace()]
        self.chunks.update(dict.fromkeys(odd))  # beside another space: such texts are cut by the slower rule
        self._learn(list(new.difference(odd)))
        out = []
        for x, p in zip(data, parts):
            found = list(map(self.chunks.__getitem__, p))
            if None in found:
                p = _SAFE.split(x)
                rest = dict.fromkeys(c for c in p if self.chunks.get(c) is None)
                held = {c: self.chunks[c] for c in p if c not in rest}
                left = {c: b"".join(map(self._piece, self.cut(" " + c))) for c in rest}
                held |= {c: (left[c], np.array(self.b.encode(c), "<u4").tobytes()) for c in rest}
                found = [held[c] for c in p]
            out.append((b"".join([a for a, _ in found]), b"".join([b for _, b in found])))
        return out


def lanes(text: str, apart: bool = True) -> list[str]:
    """The text cut at spaces that end a chunk, after every ``LANE`` characters or more; those spaces are left out."""
    out, begin = [], 0
    while apart and len(text) - begin > 2 * LANE and (m := _SAFE.search(text, begin + LANE)):
        out.append(text[begin : m.start()])
        begin = m.end()
    return [*out, text[begin:]]


def merge(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray, a_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links and cuts, as rows (place in A, place in B), of all lanes in lockstep.

    a_ends, b_ends: byte ends of the tokens of all lanes, one lane behind the other.  a_starts, b_starts,
    a_stops: first tokens of each lane on either side, and where its A tokens stop; lanes without tokens don't come.
    """
    state = np.stack([a_starts, b_starts, a_stops]).astype(np.int64)
    links, cuts = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    while state.shape[1]:
        places = state[:2].copy()
        links.append(places)
        ahead = a_ends[places[0]] - b_ends[places[1]]
        both = ahead == 0
        if both.any():
            cuts.append(places[:, both])
        state[0] += ahead <= 0
        state[1] += ahead >= 0
        done = state[0] >= state[2]
        if done.any():
            state = state[:, ~done]
    return np.concatenate(links, axis=1), np.concatenate(cuts, axis=1)


class Speller:
    """Digits of ids with what stands behind them."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.table = [f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in range(size)]

    def groups(self, a: np.ndarray, b: np.ndarray, cuts: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray, n_docs: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[cuts[0]], b_last[cuts[1]] = True, True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n_groups = int(a_last.sum())
        before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=n_groups))])
        until = np.cumsum(np.bincount(a_group, minlength=n_groups))
        spelled = np.zeros(len(a) + len(b), np.int64)
        spelled[np.arange(len(a)) + before[a_group]] = a + self.size * a_last
        end = np.append(docs_b[1:] != docs_b[:-1], True)[: len(b)]
        spelled[np.arange(len(b)) + until[b_group]] = b + self.size * np.where(end, 3, np.where(b_last, 2, 0))
        stops = np.cumsum(np.bincount(docs_a, minlength=n_docs) + np.bincount(docs_b, minlength=n_docs)).tolist()
        words = list(map(self.table.__getitem__, spelled.tolist()))
        return [b"".join(words[x:y]) for x, y in zip([0, *stops], stops)]


def _packed(codes: np.ndarray, times: np.ndarray, owner: np.ndarray, n: int) -> tuple[list[bytes], list[bytes]]:
    """Codes (8 bytes, or 4 where they fit) and times (1 byte; more often means more entries) of each document."""
    parts = -(-times // 255)
    each = np.minimum(255, np.repeat(times, parts) - 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)))
    at = np.searchsorted(np.repeat(owner, parts), np.arange(n + 1)).tolist()
    codes, each = np.repeat(codes, parts), each.astype(np.uint8)
    return [codes[x:y].tobytes() for x, y in zip(at, at[1:])], [each[x:y].tobytes() for x, y in zip(at, at[1:])]


def align_texts(data: list[bytes], sides: Sides, speller: Speller) -> list[list]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, codes and times of whole texts."""
    n = len(data)
    cut = [lanes(x.decode("utf-8", "replace"), sides.apart) if x else [] for x in data]
    coded = iter(sides.encode([p for parts in cut for p in parts]))
    left, right, owner = [], [], []
    for i, (x, parts) in enumerate(zip(data, cut)):
        own = [next(coded) for _ in parts]
        pairs = [(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for a, b in own]
        whole = b" " + x
        if parts and all(b"".join(map(t.__getitem__, np.concatenate(s).tolist())) == whole for t, s in zip((sides.a_bytes, sides.b_bytes), zip(*pairs))):
            left += [a for a, _ in pairs]
            right += [b for _, b in pairs]
            owner += [i] * len(pairs)
    sizes = [np.array([len(x) for x in s], np.int64) for s in (left, right)]
    a, b = (np.concatenate([np.zeros(0, "<u4"), *s]).astype(np.int64) for s in (left, right))
    docs_a, docs_b = (np.repeat(np.array(owner, np.int64), s) for s in sizes)
    a_stops, b_stops = (np.cumsum(s) for s in sizes)
    links, cuts = merge(np.cumsum(sides.a_sizes[a]), np.cumsum(sides.b_sizes[b]), a_stops - sizes[0], b_stops - sizes[1], a_stops)
    space = len(sides.a_bytes) * len(sides.b_bytes)
    met, times = np.unique(docs_a[links[0]] * space + a[links[0]] * len(sides.b_bytes) + b[links[1]], return_counts=True)
    codes, each = _packed((met % space).astype("<u4" if space < 1 << 32 else "<u8"), times, met // space, n)
    counts = [np.bincount(x, minlength=n).tolist() for x in (docs_a, docs_b, docs_a[cuts[0]], docs_a[links[0]])]
    spelled = speller.groups(a, b, cuts, docs_a, docs_b, n)
    return [*counts, [hashlib.sha256(x).hexdigest() if x else "" for x in spelled], codes, each]


_SIDES: dict = {}


def _sides(key: tuple, spec: str, pattern: str, pieces: bytes) -> tuple[Sides, Speller]:
    if key not in _SIDES:
        _SIDES.clear()
        sides = Sides(spec, pattern, pieces)
        _SIDES[key] = sides, Speller(max(len(sides.a_bytes), len(sides.b_bytes)))
    return _SIDES[key]


COUNTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}


def _entries(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, times and row starts of a batch whose last two columns are packed ones."""
    codes, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(times).to_numpy())]).astype(np.int64)
    return (np.frombuffer(b"".join(codes.to_pylist()), kind).astype(np.int64), np.frombuffer(b"".join(times.to_pylist()), np.uint8).astype(np.int64), starts)


def _pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """(code, n): links of each token pair in the corpus; tasks sum before they send."""
    def run(batches):
        def summed(held):
            codes, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, back, np.concatenate([x for _, x in held]))
            return codes, n

        held, size = [], 0
        for whole in batches:
            for start in range(0, len(whole), 1000):
                codes, times, _ = _entries(whole.slice(start, 1000), kind)
                held.append((codes, times))
                size += len(codes)
                if size > 2_000_000:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["code", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed(held)], names=["code", "n"])

    return aligned.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _sums(aligned: DataFrame, keep: list[str], kind: str, shared) -> DataFrame:
    """n_best and count_sum over the links whose pair is among the shared ones."""
    names = ["__row", *keep, *COUNTS]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*[f"`{c}`" for c in names]).schema) + ", n_best long, count_sum long"

    def run(batches):
        known, n, top = shared.value
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                codes, times, starts = _entries(batch, kind)
                at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
                hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                at = at[hit]
                sums = []
                for value in (np.where(top[at], times[hit], 0), times[hit] * n[at]):
                    each = np.zeros(len(codes) + 1, np.int64)
                    each[1:][hit] = value
                    sums.append(np.diff(np.cumsum(each)[starts]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])

    return aligned.select(*[f"`{c}`" for c in names], "codes", "times").mapInArrow(run, schema)


def _others(aligned: DataFrame, kind: str, shared) -> DataFrame:
    """(row, code, times) of the pairs that aren't shared."""
    def run(batches):
        known = shared.value[0]
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                codes, times, starts = _entries(batch, kind)
                rest = ~np.isin(codes, known)
                rows = np.repeat(batch.column(0).to_numpy(), np.diff(starts))
                yield pa.RecordBatch.from_arrays([pa.array(x[rest]) for x in (rows, codes, times)], names=["row", "code", "times"])

    return aligned.select("__row", "codes", "times").mapInArrow(run, "row long, code long, times long")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, keep: list[str], letters: str, pattern: str, pieces: str, text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``keep`` columns and what the two tokenizations of a space and each whole text have in common.

    n_a, n_b: tokens; n_groups: runs between byte offsets where both sides end a token; n_links: token occurrences
    that overlap; n_best: links whose id pair is the most frequent one of its B id in the corpus, ties included;
    count_sum: corpus counts of the id pairs, summed over the links; groups_sha256: digest of the groups' ids.
    Null and empty texts, and those whose tokens don't give back their bytes, have zeros and ''.  Repeated rows
    count as often as they come.  An empty table gives no rows.  Rows aren't joined by a kept column, so ids may
    repeat or be null; a kept column with the name of a new one gives way.
    letters, pieces: files of the byte-level vocabulary (A) and of the piece model (B), read on the driver.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in (*COUNTS, "n_best", "count_sum")]
    spec, model = _read(letters).decode(), _read(pieces)
    context = docs.sparkSession.sparkContext
    files = context.broadcast((spec, model))
    key = (hashlib.sha256(spec.encode()).hexdigest(), hashlib.sha256(model).hexdigest(), pattern)
    own = Sides(spec, pattern, model)
    n_right = len(own.b_bytes)
    kind = "<u4" if len(own.a_bytes) * n_right < 1 << 32 else "<u8"

    def compute(batches):
        sides, speller = _sides(key, files.value[0], pattern, files.value[1])
        for batch in batches:
            yield align_texts(text_bytes(batch, text), sides, speller)

    found = row_wise(docs, keep, text, COUNTS | {"codes": "binary", "times": "binary"}, compute)
    aligned = materialize(found.select(F.monotonically_increasing_id().alias("__row"), "*"), "aligned")
    counted = materialize(_pair_counts(aligned, kind), "pairs")
    most = counted.groupBy((F.col("code") % n_right).alias("b")).agg(F.max("n").alias("most"))
    pairs = counted.join(most, (counted["code"] % n_right) == most["b"]).select("code", "n", (F.col("n") == F.col("most")).alias("top"))
    n_pairs, least = counted.count(), 0
    if n_pairs > most_pairs:  # the least count that leaves few enough pairs
        sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.col("n").desc())
        held, least = 0, None
        for n, size in sizes.toLocalIterator():
            if held + size > most_pairs:
                break
            held, least = held + size, n
    shared_pairs = pairs.where(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    order = np.argsort(shared_pairs["code"].to_numpy())
    shared = context.broadcast(tuple(shared_pairs[c].to_numpy()[order] for c in ("code", "n", "top")))
    out = _sums(aligned, keep, kind, shared)
    if n_pairs > len(shared_pairs):
        rest = _others(aligned, kind, shared).join(pairs, "code").groupBy("row").agg(
            F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(rest, out["__row"] == rest["row"], "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
