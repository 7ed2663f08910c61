"""The pipeline against plain Python, stage by stage and as a whole."""

import base64
import hashlib

import pytest

import corpus_pipeline
from riskloom.llm import secrets
from tests.llm.test_shards_simhash import plain_classes
from tests.llm.test_text_jobs import plain_hits, plain_quality


def test_run(spark, sf):
    tiktoken, p = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(corpus_pipeline.VOCABULARY), "rb"))}
    code = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    measured = {d[0]: plain_quality(d[1]) for d in docs}
    docs = [d for d in docs if measured[d[0]][0] >= 10 and 100 * measured[d[0]][4] <= 20 * measured[d[0]][0]]
    leaders = {c for _, _, c in plain_classes([d[:2] for d in docs])}
    docs = [d for d in docs if d[0] in leaders and not plain_hits(d[1], items)[-1]]
    want = []
    for i, t, lang, source in docs:
        t = secrets.redact_text(t)
        ids = code.encode_ordinary(t)
        want.append((i, lang, source, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    out = corpus_pipeline.run(spark, sf).drop("ids").collect()
    assert sorted(map(tuple, out)) == sorted(want) and len(want) > 50


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).schema.names == docs.columns
        kept = corpus_pipeline.secret_scan(spark, docs, sf)
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.byte_bpe(spark, odd_docs, sf).count() == odd_docs.count() and corpus_pipeline.byte_bpe(spark, no_docs, sf).collect() == []
