"""From raw documents to token ids: quality rules, near duplicates, benchmark passages, secrets, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, quality, secrets, simhash
from riskloom.llm.common import table
from riskloom.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the document and host rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each near-duplicate class."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, secrets replaced by a mark; ``n_chars`` follows where a text changed."""
    columns = docs.columns
    wide = docs.select(F.struct(*[f"`{c}`" for c in columns]).alias("__row"), F.col("text").alias("__text"))
    clean = secrets.redact(wide, "__text")
    n_chars = F.when(F.col("__text").eqNullSafe(F.col("__row.text")), F.col("__row.n_chars")).otherwise(F.length("__text").cast("long"))
    new = {"text": F.col("__text"), "n_chars": n_chars}
    return clean.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids (little-endian unsigned 32 bit), their number, and digests of the ids and of what they decode to."""
    path, keep = public_tokenizers.path(VOCABULARY), ["doc_id", "lang", "source"]
    back = bpe.encode(docs.select(*keep, "text"), keep, path, public_tokenizers.PATTERN, back=True)
    return back.select(*keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret scan", secret_scan), ("byte-level BPE", byte_bpe)]

#: Fingerprints, merges and entropy windows are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
