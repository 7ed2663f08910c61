"""The registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import align, bpe, decontaminate, language_model, lexical, minhash, quality, repeats, secrets, shards, simhash, token_files, toxicity
from riskloom.llm.common import table
from riskloom.session import materialize

BPE_FILE, LIBRARY_FILE, PIECE_FILE, END_ID = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", 2


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, ["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.split(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.scan(docs, benchmark, ["doc_id"])


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = language_model.score(docs, ["doc_id"], language_model.not_held_out())
    held = F.coalesce(toxicity.remainder("doc_id", 5) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(quality.measure(table(spark, sf_dir, "documents"), ["doc_id", "source"]), "measures")
    return quality.judge(measured).select("doc_id", *quality.MEASURES, "base_failed", "kept", "host_rejected")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tokenizers()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.encode(docs, ["doc_id"], p.path(BPE_FILE), p.PATTERN, back=True)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample, share = toxicity.training_sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", 2_000, 4_000,
                                             lambda c: toxicity.remainder(c, 4) != 2)
    scored = toxicity.score(docs, ["doc_id"], toxicity.fit(sample, share))
    held = F.coalesce(toxicity.remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_spans")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tokenizers()
    files = token_files.write(table(spark, sf_dir, "documents"), token_files.fresh_folder(spark), p.path(LIBRARY_FILE), p.PATTERN, END_ID)
    return token_files.read(spark, files)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, ["doc_id"], width=2)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tokenizers()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, ["doc_id"], p.path(LIBRARY_FILE), p.PATTERN, p.path(PIECE_FILE))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_shards, op3_decontaminate, op4_language_model, op5_quality, op6_bpe, op7_repeats,
                                  op8_toxicity, op9_token_files, op10_secrets, op11_minhash, op12_align, op13_search)}

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

CHECKS: dict[str, str] = {
    "op13_search": f"""
WITH docs AS (SELECT doc_id, ts, len(ts) AS n FROM (SELECT doc_id, {_TERMS} AS ts FROM documents) WHERE len(ts) > 0),
totals AS (SELECT count(*) AS docs, sum(n) AS terms FROM docs),
postings AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM docs) GROUP BY ALL),
asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * CAST((SELECT docs FROM totals) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w
            FROM postings GROUP BY t),
lengths AS (SELECT doc_id, 100 - 25 + ((25 * CAST(n AS HUGEINT) * (SELECT docs FROM totals)) // (SELECT terms FROM totals)) AS m FROM docs),
sums AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
         FROM asked JOIN postings USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM sums WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
