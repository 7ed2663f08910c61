"""Cuts texts into the pieces that byte-level vocabularies encode one by one, and caches their ids.

Most pieces of a corpus repeat.  A text is cut at single spaces between solid characters,
where no piece can cross; each chunk is looked up, and only new chunks are cut
by the pattern and encoded.  Caches are bounded: a full one keeps the half that came first, where frequent
words are, which costs time only.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The characters with the Unicode property White_Space.
_WHITE = "\t-\r \\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def piece_pattern(pattern: str):
    """``pattern`` with \\s and \\S read as in the vocabularies' own engines."""
    inside = re.sub(r"\[\^([^\]]*)\\s", lambda m: f"[^{m[1]}{_WHITE}", pattern)
    return regex.compile(inside.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


class ChunkCoder:
    """Ids of whole texts as little-endian unsigned integers of ``kind``.

    encode: gets a list of distinct pieces and returns their ids in the same order.
    """

    def __init__(self, pattern: str, encode, kind: str = "<u4", most: int = 450_000) -> None:
        self.cut = piece_pattern(pattern).findall
        self.encode, self.kind, self.most = encode, np.dtype(kind), most
        self.chunks: dict[str, bytes | bool] = {}
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        self.chunks, self.known = {}, {}

    def _learn(self, pieces) -> None:
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        ids = self.encode(new)
        ends = list(accumulate((len(x) * self.kind.itemsize for x in ids), initial=0))
        flat = np.fromiter(chain.from_iterable(ids), self.kind, ends[-1] // self.kind.itemsize).tobytes()
        self.known.update((p, flat[a:b]) for p, a, b in zip(new, ends, ends[1:]))

    def _cut_chunks(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """Pieces of all the chunks in a row, and where each chunk's begin, with the end of the last.

        No piece crosses the space before a chunk, and a chunk has none inside, so they are cut all at once.  Where the pattern
        does not keep that space at the start of a piece, they are cut one by one.
        """
        pieces = self.cut(" " + " ".join(chunks)) if chunks else []
        begins = [i for i, p in enumerate(pieces) if p[0] == " "]
        if len(begins) == len(chunks) and " " not in pieces and begins[:1] in ([], [0]):
            return pieces, [*begins, len(pieces)]
        cut = [self.cut(" " + c) for c in chunks]
        return list(chain.from_iterable(cut)), list(accumulate(map(len, cut), initial=0))

    def prepare(self, data: list[str]) -> tuple[list[bytes | bool], np.ndarray, np.ndarray, np.ndarray]:
        """Cut texts into chunks and learn every new chunk of all of them together.

        Ids of each distinct chunk, whether a text that has it is cut by the slower rule, the chunks of all texts in a row by number, and where each text's begin.
        """
        if len(self.chunks) > self.most:
            self.chunks = dict(islice(self.chunks.items(), self.most // 2))
        if len(self.known) > self.most:
            self.known = dict(islice(self.known.items(), self.most // 2))
        # Arrow splits the texts and numbers their chunks, so that each chunk of them is looked up once; a first chunk has no space before it
        parts = pc.split_pattern(pa.array(data, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        begins = parts.offsets.to_numpy()
        found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().astype(np.int64)
        heads = [found[i] for i in at[begins[:-1]].tolist()]
        at[begins[:-1]] = len(found) + np.arange(len(data))
        chunks = self.chunks
        held = np.zeros(len(found), bool)
        held[at[at < len(found)]] = True  # a chunk that only begins texts is not learned
        new = [c for c, h in zip(found, held.tolist()) if h and c not in chunks]
        regular = []
        for c in new:
            if not c or c[0].isspace() or c[-1].isspace():
                chunks[c] = False  # beside another space: such texts are cut by the slower rule
            else:
                regular.append(c)
        pieces, cuts = self._cut_chunks(regular)
        firsts = [self.cut(h) for h in heads]
        self._learn(chain(pieces, *firsts))
        ids = list(map(self.known.__getitem__, pieces))
        for c, a, b in zip(regular, cuts, cuts[1:]):
            chunks[c] = ids[a] if b - a == 1 else b"".join(ids[a:b])
        values = [chunks[c] if h else b"" for c, h in zip(found, held.tolist())]
        odd = np.array([*(v is False for v in values), *(h[-1:].isspace() for h in heads)], bool)
        values += [b"".join(map(self.known.__getitem__, f)) for f in firsts]
        return values, odd, at, begins

    def ids(self, data: list[str]) -> list[bytes]:
        if not data:
            return []
        values, odd, at, begins = self.prepare(data)
        slow = np.add.reduceat(odd[at], begins[:-1]) > 0  # a text has one chunk at least
        laid = pa.array([v or b"" for v in values], pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(laid.buffers()[1], np.int64)[begins].tolist()
        flat = memoryview(laid.buffers()[2] or b"")
        return [self._slow(x) if s else bytes(flat[a:b]) for x, s, a, b in zip(data, slow.tolist(), ends, ends[1:])]

    def _slow(self, x: str) -> bytes:
        first, *rest = _SAFE.split(x)
        pieces = self.cut(first)
        for c in rest:
            pieces += self.cut(" " + c)
        self._learn(pieces)
        return b"".join(map(self.known.__getitem__, pieces))
