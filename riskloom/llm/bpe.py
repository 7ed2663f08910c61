"""Byte-level BPE by corpus-level merge replay.

The merges of one word never look at another word, so any set of distinct words can be
replayed together: an inverted index leads from each pair of neighbouring tokens to the
positions that have it, and pairs are applied in rank order, each application touching only the two
neighbours.  The words of a slice of the corpus are replayed at once on each executor; no text moves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame

from riskloom.llm.common import row_wise, texts
from riskloom.llm.pieces import ChunkCoder

_CODERS: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class MergeReplay:
    """Ids of words by merges in rank order; ``together`` is the bytes of words replayed at once."""

    def __init__(self, ranks: dict[bytes, int], together: int = 500_000) -> None:
        self.ranks, self.together = ranks, together
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        known = np.flatnonzero(self.first >= 0)
        self.bytewise = dict(zip((self.single[known >> 8] << 32 | self.single[known & 255]).tolist(), self.first[known].tolist()))
        self.pairs: dict[int, int] = dict(self.bytewise)

    def forget(self) -> None:
        self.pairs = dict(self.bytewise)

    def pair(self, a: int, b: int) -> int:
        """Rank of two neighbouring tokens, -1 for none; kept under ``a << 32 | b``."""
        rank = self.pairs[a << 32 | b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: always the pair of least rank first, the leftmost of equal ones."""
        out: list[list[int]] = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        some: list[int] = []
        size = 0
        for n, w in enumerate(words):
            if w and not out[n]:
                some.append(n)
                size += len(w)
                if size >= self.together:
                    self._replay(words, some, out)
                    some, size = [], 0
        if some:
            self._replay(words, some, out)
        return out

    def _replay(self, words: list[bytes], some: list[int], out: list[list[int]]) -> None:
        """Fills ``out`` for the words numbered in ``some``."""
        data = np.frombuffer(b"".join([words[n] for n in some]), np.uint8).astype(np.int64)
        ends = np.cumsum([len(words[n]) for n in some])
        begins = np.concatenate([[0], ends[:-1]])
        places = np.arange(len(data))
        following, preceding = places + 1, places - 1  # within the word, -1 beyond it
        following[ends - 1] = preceding[begins] = -1
        rank_at = self.first[data[:-1] << 8 | data[1:]]
        rank_at[ends[:-1] - 1] = -1
        order = np.argsort(rank_at, kind="stable")
        order = order[np.searchsorted(rank_at[order], 0) :]
        met, cuts = np.unique(rank_at[order], return_index=True)
        index = dict(zip(met.tolist(), (x.tolist() for x in np.split(order, cuts[1:]))))
        token, after, before = self.single[data].tolist(), following.tolist(), preceding.tolist()
        if len(self.pairs) > 200_000:
            self.forget()
        pair, get = self.pair, self.pairs.get
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            for k, i in enumerate(positions):
                j = after[i]
                if j < 0 or get(token[i] << 32 | token[j]) != rank:  # a merged token is -1, which no key has
                    continue
                token[i], token[j] = rank, -1
                after[i] = j = after[j]
                lower = False
                if j >= 0:
                    before[j] = i
                    r = get(rank << 32 | token[j])
                    if r is None:
                        r = pair(rank, token[j])
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            heapq.heappush(ranks, r)
                            index[r] = [i]
                        lower = r < rank
                h = before[i]
                if h >= 0:
                    r = get(token[h] << 32 | rank)
                    if r is None:
                        r = pair(token[h], rank)
                    if r >= 0:
                        if r in index:
                            index[r].append(h)
                        else:
                            heapq.heappush(ranks, r)
                            index[r] = [h]
                        lower |= r < rank
                if lower:  # a pair of less rank has come up and goes first
                    index.setdefault(rank, []).extend(positions[k + 1 :])
                    heapq.heappush(ranks, rank)
                    break
        for n, i in zip(some, begins.tolist()):
            ids = out[n]
            while i >= 0:
                ids.append(token[i])
                i = after[i]


def coder(path_key: str, ranks: dict[bytes, int], pattern: str) -> tuple[ChunkCoder, MergeReplay]:
    """One coder for each vocabulary and worker process."""
    if path_key not in _CODERS:
        replay = MergeReplay(ranks)
        _CODERS[path_key] = ChunkCoder(pattern, lambda words: replay.encode([w.encode() for w in words]), most=200_000), replay
    return _CODERS[path_key]


def decode(ids: bytes, bytes_of: dict[int, bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shared(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    return key, docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))


def encode(docs: DataFrame, keep: list[str], vocabulary: str, pattern: str, text: str = "text", back: bool = False) -> DataFrame:
    """``keep`` columns and ``ids``, the token ids of each whole text as little-endian unsigned 32-bit integers.

    back: add ``decoded``, the bytes that the ids stand for, decoded in the same task.

    vocabulary: file of base64 tokens and ranks, read by the driver (its size is that of the vocabulary).
    A null or empty text has no ids.
    """
    key, shared = _shared(docs, vocabulary)

    def compute(batches):
        code, replay = coder(key + pattern, shared.value, pattern)
        for batch in batches:
            ids = code.ids(texts(batch, text))
            yield [ids, [decode(x, replay.bytes_of) for x in ids]] if back else [ids]
        code.forget()  # the worker may serve other stages next
        replay.forget()

    return row_wise(docs, keep, text, {"ids": "binary", "decoded": "binary"} if back else {"ids": "binary"}, compute)


def decoded(encoded: DataFrame, keep: list[str], vocabulary: str, ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``, the bytes that the ids stand for."""
    _, shared = _shared(encoded, vocabulary)

    def compute(batches):
        bytes_of = {v: k for k, v in shared.value.items()}
        for batch in batches:
            yield [[decode(x or b"", bytes_of) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]]

    return row_wise(encoded, keep, ids, {"decoded": "binary"}, compute)
