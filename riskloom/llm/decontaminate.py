"""Finds benchmark passages in documents by a broadcast set of normalised word windows."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_wise, text_bytes

#: Bytes of a word: digits, letters, and all of a character outside ASCII.
_WORD = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _WORD[_b] = _b
for _b in range(65, 91):
    _WORD[_b] = _b + 32
_R = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1342543DE82EF95)
_KEEP_WORDS = bytes(int(x) or 32 for x in _WORD)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP_WORDS).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base & (2**64 - 1)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & (2**64 - 1)
    return out[:n]


class Hasher:
    """Word positions and word hashes of a buffer; power tables are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, starts, ends, hashes)."""
        low = _WORD[np.frombuffer(data, np.uint8)]
        if len(low) + 1 > len(self.up):
            self.up, self.down = (_powers(b, len(low) + 1) for b in (_R, pow(_R, -1, 2**64)))
        on = np.concatenate([[False], low > 0, [False]])
        edge = np.flatnonzero(on[1:] != on[:-1])
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low.astype(np.uint64) * self.up[: len(low)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(31)
        h *= _STEP
        return low, starts, ends, h ^ (h >> np.uint64(29))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _STEP
        out += h[j : j + n]
    return out


class WindowSet:
    """Windows by length, looked up by hash and then compared word for word."""

    BITS = 20

    def __init__(self, windows: dict[bytes, list[int]]) -> None:
        """windows: words joined by spaces, to the numbers of the items that have them."""
        hasher = Hasher()
        self.items = windows
        by_width: dict[int, list[int]] = {}
        for w in windows:
            h = hasher.words(w)[3]
            by_width.setdefault(len(h), []).append(int(window_hashes(h, len(h))[0]))
        self.hashes = {k: np.unique(np.array(v, np.uint64)) for k, v in by_width.items()}
        self.maps = {}
        for k, v in self.hashes.items():
            self.maps[k] = np.zeros(1 << self.BITS, bool)
            self.maps[k][v >> np.uint64(64 - self.BITS)] = True

    def hits(self, h: np.ndarray, width: int) -> np.ndarray:
        w = window_hashes(h, width)
        at = np.flatnonzero(self.maps[width][w >> np.uint64(64 - self.BITS)])
        known = self.hashes[width]
        return at[known[np.minimum(np.searchsorted(known, w[at]), len(known) - 1)] == w[at]]


def scan_texts(data: list[bytes], found: WindowSet, hasher: Hasher) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: number of words, hit byte ranges (one per word), numbers of items met."""
    buffer = b"\0".join(data) + b"\0"
    low, starts, ends, h = hasher.words(buffer)
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])])
    first = np.searchsorted(starts, begins)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(data)), n_words)
    hit = np.zeros(len(starts), bool)
    items: list[set[int]] = [set() for _ in data]
    raw = low.tobytes()
    for width in found.hashes:
        for i in found.hits(h, width).tolist():
            if owner[i] != owner[i + width - 1]:
                continue
            words = b" ".join(raw[a:b] for a, b in zip(starts[i : i + width].tolist(), ends[i : i + width].tolist()))
            if (met := found.items.get(words)) is not None:
                hit[i : i + width] = True
                items[owner[i]].update(met)
    spans: list[list[tuple[int, int]]] = [[] for _ in data]
    for i in np.flatnonzero(hit).tolist():
        spans[owner[i]].append((int(starts[i] - begins[owner[i]]), int(ends[i] - begins[owner[i]])))
    return list(zip(n_words.tolist(), spans, items))


def item_windows(benchmark: DataFrame, width: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item) of the benchmark; an item of fewer words, but not none, is one window."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict[str, list] = {"w": [], "id": []}
            for i, x in zip(ids, text_bytes(batch, text)):
                words = words_of(x)
                grams = {b" ".join(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else ()
                out["w"] += grams
                out["id"] += [i] * len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(out["w"], pa.binary()), pa.array(out["id"], pa.string())], names=["w", "id"])

    rows = benchmark.select(F.col(item).cast("string").alias("id"), F.col(text).alias(text))
    return rows.mapInArrow(run, "w binary, id string").distinct()


FOUND = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", width: int = 10,
         most_windows: int = 2_000_000) -> DataFrame:
    """``keep`` columns of each row and what of the benchmark its whole text holds.

    A word is hit inside any occurrence of a window.  The set of windows is broadcast, and
    its size is counted first: over ``most_windows`` it raises, since a benchmark of that size is
    no benchmark; split the benchmark and scan once for each part.  Documents are read once
    and never moved.  A null or empty text has no words and no hit.  An item with null id marks
    words but isn't counted among the items.
    """
    windows = item_windows(benchmark, width)
    n = windows.count()
    if n > most_windows:
        raise ValueError(f"{n} benchmark windows are more than most_windows={most_windows}")
    ids: dict[str, int] = {}
    held: dict[bytes, list[int]] = {}
    for w, i in windows.toLocalIterator():
        held.setdefault(bytes(w), [])
        if i is not None:
            held[bytes(w)].append(ids.setdefault(i, len(ids)))
    shared = docs.sparkSession.sparkContext.broadcast((held, list(ids)))

    def compute(batches):
        windows, names = shared.value
        found, hasher = WindowSet(windows), Hasher()
        for batch in batches:
            rows = []
            for n_words, spans, items in scan_texts(text_bytes(batch, text), found, hasher):
                listed = ",".join(sorted(names[i] for i in items))
                rows.append((n_words, len(spans), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(spans)))
            yield [list(c) for c in zip(*rows)] or [[] for _ in FOUND]

    return row_wise(docs, keep, text, FOUND, compute)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the hit words; what stands between two hit words of a run goes too."""
    out, at, last = [], 0, None
    for a, b in spans:
        between = text[last:a] if last is not None else b""
        if last is None or between.translate(_KEEP_WORDS).split():
            out.append(text[at:a])
        at = last = b
    return b"".join(out) + text[at:]


def drop_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10,
               most_windows: int = 2_000_000) -> DataFrame:
    """``docs`` with the hit words of each text cut out; null stays null."""
    windows = item_windows(benchmark, width)
    if (n := windows.count()) > most_windows:
        raise ValueError(f"{n} benchmark windows are more than most_windows={most_windows}")
    shared = docs.sparkSession.sparkContext.broadcast([bytes(r[0]) for r in windows.select("w").distinct().toLocalIterator()])

    def compute(batches):
        found, hasher = WindowSet({w: [] for w in shared.value}), Hasher()
        for batch in batches:
            nulls = batch.column(batch.schema.get_field_index(text)).is_null().to_pylist()
            data = text_bytes(batch, text)
            out = [cut_spans(x, s[1]).decode("utf-8", "replace") for x, s in zip(data, scan_texts(data, found, hasher))]
            yield [[None if n else x for n, x in zip(nulls, out)]]

    return row_wise(docs, docs.columns, text, {text: "string"}, compute).select(*[f"`{c}`" for c in docs.columns])


def drop_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10) -> DataFrame:
    """``docs`` without those that hold a benchmark window."""
    keep = docs.columns
    wide = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    found = scan(wide, benchmark, ["__row"], "__text", width)
    return found.where(~F.col("contaminated")).select("__row.*")
