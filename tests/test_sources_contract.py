"""Readers, writers, the end-to-end run and the driver contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.config import BoosterSpec, SamplingSpec
from riskloom.operators import responses
from riskloom.sources import readers as R
from riskloom.sources import writers as W

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_csv_keeps_quotes_newlines_and_blanks(spark, tmp_path):
    rows = [('say "hi",\nthen go', " padded "), ("comma, too", "x")]
    df = spark.createDataFrame(rows, "question string, answer string")
    W.write_table(df, str(tmp_path / "c"))
    back = R.scan_csv(spark, "math", str(tmp_path / "c"))
    assert sorted((r.question, r.answer) for r in back.collect()) == sorted(rows)
    assert {(r.domain, r.domain_key) for r in back.collect()} == {("Math", "math")}


def test_unknown_dataset_and_missing_files(spark, tmp_path):
    with pytest.raises(ValueError):
        R.scan_csv(spark, "law", str(tmp_path))
    with pytest.raises(ValueError):
        R.load_all_domains(spark, [("math", str(tmp_path / "nowhere"))])
    with pytest.raises(ValueError):
        R.standardize(spark.range(1), R.spec_of("math"))


def test_load_domain_numbers_before_filtering(spark, tmp_path):
    path = tmp_path / "answers.csv"
    path.write_text('question,answer,documents\nq0,a0,d0\nq1,a1,"  "\nq2,a2,d2\n')
    got = R.load_domain(spark, "is_agents", str(path)).orderBy("prompt_id").collect()
    assert [(r.prompt_id, r.prompt, r.domain) for r in got] == [("is_agents_0", "q0", "IS"), ("is_agents_2", "q2", "IS")]


def test_row_position_over_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7)
    got = [(r.id, r.position) for r in R.with_row_position(df).collect()]
    assert all(i == p for i, p in got) and len(got) == 1000


def test_nested_json_array_files(spark, tmp_path):
    docs = [{"table": {"uid": "u", "table": [["a", "1"], ["b", None]]},
             "paragraphs": [{"order": 2, "text": "second"}, {"order": 1, "text": "first"}, {"text": "zero"}],
             "questions": [{"question": "q0", "answer": "x", "answer_type": "span"}, {"question": "q1", "answer": "y"}]},
            {"paragraphs": [{"order": 1, "text": "only"}], "questions": [{"question": "q2", "answer": "z"}]},
            {"questions": []}]
    for stem in ("train", "dev"):
        (tmp_path / f"{stem}.json").write_text(json.dumps(docs))
    raw = R.number_documents(R.scan_nested(spark, str(tmp_path), multi_line=True))
    got = {r.id: r for r in R.explode_questions(raw, F.col("doc_id")).collect()}
    assert set(got) == {f"{s}_doc{d}_q{q}" for s in ("train", "dev") for d, q in ((0, 0), (0, 1), (1, 0))}
    assert got["dev_doc0_q1"].context == "zero\n\nfirst\n\nsecond\n\nTABLE:\na | 1\nb | None"
    assert got["dev_doc1_q0"].context == "only" and got["dev_doc1_q0"].table_uid == ""
    assert got["dev_doc0_q1"].answer_type == ""
    split = {r.id: r for r in R.explode_questions(R.scan_nested_arrays(spark, str(tmp_path)), F.col("doc_id")).collect()}
    assert split == got


def test_feature_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", 1.5), ("q", "b", 2.5)], "prompt_id string, domain string, f double")
    W.write_features(df, str(tmp_path / "x"), "feather", by=["domain"])
    assert spark.read.parquet(str(tmp_path / "x")).filter("domain = 'b'").first().f == 2.5
    W.write_features(df, str(tmp_path / "y"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "y")).count() == 2
    with pytest.raises(ValueError):
        W.write_features(df, str(tmp_path / "z"), "xlsx")


def test_sampling_temperatures():
    assert responses.temperatures(SamplingSpec()) == pytest.approx([0.7, 0.775, 0.85, 0.925, 1.0])
    assert responses.temperatures(SamplingSpec(n_samples=1)) == pytest.approx([0.85])


def test_request_key_ignores_argument_order(spark):
    df = spark.range(1).select(
        responses.request_key(F.lit("p"), F.lit("m"), F.lit("v"), top_p=F.lit(0.9), n=F.lit(1)).alias("a"),
        responses.request_key(F.lit("p"), F.lit("m"), F.lit("v"), n=F.lit(1), top_p=F.lit(0.9)).alias("b"),
        responses.request_key(F.lit("p"), F.lit("m"), F.lit("v"), n=F.lit(2), top_p=F.lit(0.9)).alias("c"))
    row = df.first()
    assert row.a == row.b != row.c


def test_end_to_end_run(spark):
    """Every stage over the sf0.01 conversations."""
    from riskloom.plans import pipeline
    from riskloom.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.01")
    prompts = v.options.withColumn("domain", F.lit("Psychology"))
    first = v.samples.filter("sample_id = 0").select("prompt_id", "text")
    # half of the truths are the answer itself, so both classes occur
    prompts = prompts.join(first, "prompt_id", "left").withColumn(
        "ground_truth", F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.col("ground_truth"))).drop("text")
    prepared = pipeline.prepare(prompts)
    assert "formatted_prompt" in prepared.columns and prepared.count() == 100
    out = pipeline.run(prompts, v.samples, v.logprobs, v.sample_vectors, v.word_gazetteer, similarity="edit",
                       spec=BoosterSpec(n_trees=5, step_size=0.3, gamma=0.0))
    assert out.features.count() == 98
    assert out.features.filter("semantic_entropy is null or token_count is null").count() == 0
    rows = {r.model: r for r in out.metrics.collect()}
    assert rows["train"].n + rows["test"].n == 98 and rows["train"].auroc > 0.5


def test_entry_and_registry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 5
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120 and len(o) > 110


@pytest.mark.parametrize("key", ["label_math", "metrics_bundle", "stratified_split", "semantic_entropy", "contextual_features",
                                 "chi_square", "scan_nested_json", "feature_select"])
def test_spark_equals_sql(spark, sf, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[key](spark, sf)
    rel = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(dict(zip(names, r))[c] for c in df.columns)) for r in rel.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want
