"""Flat files of token ids with 64-bit document offsets.

A set of shards in ascending document order.  Shard k has three files: ``ids-k`` (flat unsigned
little-endian integers, 16 bits where the vocabulary allows, else 32), ``offsets-k`` (n + 1 unsigned 64-bit
counts of ids before each document of the shard) and ``docs-k`` (document ids, signed 64 bit).  The base of a
shard is the sum of the ids in the shards before it.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import slices, texts
from riskloom.llm.pieces import ChunkCoder
from riskloom.session import fresh_path

_CODERS: dict = {}


@dataclass(frozen=True)
class TokenFiles:
    """folder, bytes of an id, and (name, documents, ids, null document ids, base) of each shard in order."""

    folder: str
    kind: str
    shards: tuple[tuple[str, int, int, int, int], ...]


def _store(folder: str):
    """The file system of a folder and the folder's path in it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{os.path.abspath(folder)}")


class LibraryCoder(ChunkCoder):
    """The tokenizers library's ids: its model behind the shared chunk cache.

    The library cuts a text at the vocabulary's added tokens before anything else.  A text that holds the string of one
    goes through the library as it is; the others, nearly all, take the faster way, which knows no added tokens.
    """

    def __init__(self, pattern: str, encode, kind: str, whole, added: list[str]) -> None:
        super().__init__(pattern, encode, kind)
        self.whole, self.added = whole, added

    def ids(self, data: list[str]) -> list[bytes]:
        held = [any(a in x for a in self.added) for x in data]
        plain = iter(super().ids([x for x, h in zip(data, held) if not h]))
        return [np.array(self.whole(x), self.kind).tobytes() if h else next(plain) for x, h in zip(data, held)]


def _library_coder(vocabulary: str, pattern: str, kind: str) -> LibraryCoder:
    """Ids as ``encode`` of the library gives them without adding special tokens."""
    key = hash((vocabulary, pattern, kind))
    if key not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenize = tokenizer.model.tokenize
        number = attrgetter("id")

        def encode(pieces):
            return [list(map(number, tokenize(x))) for x in lettered(pieces)]

        added = [t["content"] for t in json.loads(vocabulary).get("added_tokens", ())]
        _CODERS[key] = LibraryCoder(pattern, encode, kind, lambda x: tokenizer.encode(x, add_special_tokens=False).ids, added)
    return _CODERS[key]


def lettered(pieces: list[str]) -> list[str]:
    """Pieces in the letters of byte-level vocabularies; the byte 255, which UTF-8 never has, stands between them meanwhile."""
    if not pieces:
        return []
    whole = b"\xff".join(map(str.encode, pieces)).decode("latin-1")
    for byte, letter in byte_letters().items():
        if chr(byte) != letter:
            whole = whole.replace(chr(byte), letter)
    return whole.split("\xff")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable Latin-1 characters stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def write(docs: DataFrame, folder: str, vocabulary: str, pattern: str, end: int, doc: str = "doc_id",
          text: str = "text") -> TokenFiles:
    """Encode every whole text, append ``end``, and write the shards; a null or empty text has the end alone.

    The strings of the vocabulary's added tokens become those tokens, as in the library.

    Documents are dealt to ranges of ids and sorted there (null ids first, equal ids by text), then
    encoded, so that ids never move.  A task writes files of its own name, under a fresh name for each
    attempt, and only the attempts that ended well are listed; one row for each shard reaches the driver.
    """
    with open(vocabulary) as f:
        spec = f.read()
    parsed = json.loads(spec)
    tokens = [*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed.get("added_tokens", ())), end]
    kind = "<u2" if max(tokens) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange("doc").sortWithinPartitions("doc", "text")
    last = np.array([end], kind).tobytes()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name = f"{part:07d}-{uuid.uuid4().hex}"
        code = _library_coder(shared.value, pattern, kind)
        n_docs = n_ids = n_null = 0
        files = {k: store.open_output_stream(f"{path}/{k}-{name}") for k in ("ids", "offsets", "docs")}
        files["offsets"].write(np.zeros(1, "<u8").tobytes())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n_docs += len(ids)
            n_null += sum(i is None for i in ids)
            files["docs"].write(np.array([i or 0 for i in ids], "<i8").tobytes())
            for piece in slices(batch, "text", 4_000_000):
                coded = code.ids(texts(piece, "text"))
                counts = np.array([len(x) // code.kind.itemsize + 1 for x in coded], "<u8")
                files["offsets"].write((np.cumsum(counts, dtype="<u8") + np.uint64(n_ids)).tobytes())
                files["ids"].write(last.join([*coded, b""]))
                n_ids += int(counts.sum())
        for f in files.values():
            f.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [n_docs], "ids": [n_ids], "nulls": [n_null]})

    listed = sorted(dealt.mapInArrow(run, "part long, name string, docs long, ids long, nulls long").collect())
    bases = np.concatenate([[0], np.cumsum([r["ids"] for r in listed], dtype=np.int64)]).tolist()
    return TokenFiles(folder, kind, tuple((r["name"], r["docs"], r["ids"], r["nulls"], b) for r, b in zip(listed, bases)))


def _open(store, path: str, kind: str):
    """A file's numbers: mapped into memory where the store is a local one, else read through it."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.dtype(kind), "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row for each document, in file order within a shard: doc_id, start, n_tokens, ids_crc32.

    A shard is read by one task; its size is that of one task of the writer.
    """
    folder, kind = files.folder, files.kind
    shards = spark.createDataFrame([(i, *s) for i, s in enumerate(files.shards)],
                                   "shard int, name string, docs long, ids long, nulls long, base long")

    def run(batches):
        store, path = _store(folder)
        for batch in batches:
            for s in batch.to_pylist():
                ids = _open(store, f"{path}/ids-{s['name']}", kind)
                offsets = _open(store, f"{path}/offsets-{s['name']}", "<u8").astype(np.int64)
                docs = _open(store, f"{path}/docs-{s['name']}", "<i8")
                if not (len(docs) == s["docs"] == len(offsets) - 1 and len(ids) == s["ids"] == offsets[-1]):
                    raise ValueError(f"shard {s['name']} is incomplete")
                for a in range(0, len(docs), 10_000):
                    at = offsets[a : a + 10_001]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at.tolist(), at[1:].tolist())]
                    null = np.arange(a, a + len(crc)) < s["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(docs[a : a + 10_000]), pa.int64(), mask=null), pa.array(at[:-1] + s["base"]),
                         pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, len(files.shards))
    return (shards.repartition(n, "shard").select("name", "docs", "ids", "nulls", "base")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def fresh_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "token-files")
