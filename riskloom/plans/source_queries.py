"""Scans, sinks, projections, profiles and prompt building (survey 2.1 - 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.config import DATASETS, DOMAIN_NAMES
from riskloom.functions import prompts as P
from riskloom.functions.numbers import final_answer
from riskloom.operators import metrics as M
from riskloom.operators import profiling
from riskloom.operators.ranking import positions
from riskloom.plans.eval_queries import _BUNDLE, all_scored, r6
from riskloom.plans.registry import query
from riskloom.plans.views import Views
from riskloom.session import fresh_path
from riskloom.sources import readers as R
from riskloom.sources import writers as W

KEY_OF = {name: key for key, name in DOMAIN_NAMES.items()}
_KEY_SQL = "CASE domain WHEN 'IS' THEN 'is_agents' ELSE lower(domain) END"


def _key(domain):
    return F.when(domain == "IS", "is_agents").otherwise(F.lower(domain))


def _as_csv(v: Views, df, stem: str) -> str:
    path = fresh_path(v.spark, stem)
    W.write_table(df, path)
    return path


def _raw(v: Views, key: str):
    """The prompts of one domain in that dataset's raw columns."""
    spec = DATASETS[key]
    o = v.options.filter(F.col("domain") == spec.domain)
    cols = {"question": "prompt", "answer": "ground_truth", "correct_answer": "ground_truth",
            "Question": "prompt", "Best Answer": "ground_truth", "context": "documents",
            "options": "options", "correct_index": "correct_index", "documents": "documents", "id": "prompt_id"}
    return o.select(*[F.col(cols[f.name]).alias(f.name) if f.name in cols else F.lit(None).cast("string").alias(f.name)
                      for f in R.RAW_SCHEMAS[key].fields])


# --- 2.1 scans and sinks ----------------------------------------------------

@query("scan_csv", """SELECT prompt AS question, ground_truth AS answer, 'Math' AS domain, 'math' AS domain_key
    FROM v_prompts""", ("v_prompts",))
def scan_csv(v):
    raw = v.prompts.select(F.col("prompt").alias("question"), F.col("ground_truth").alias("answer"))
    return R.scan_csv(v.spark, "math", _as_csv(v, raw, "csv"))


@query("scan_all_domains", f"""SELECT domain, {_KEY_SQL} AS domain_key, prompt, ground_truth,
      CASE WHEN domain IN ('Finance', 'IS') THEN documents END AS documents,
      CASE WHEN domain = 'Medicine' THEN options END AS options,
      CASE WHEN domain = 'Medicine' THEN correct_index END AS correct_index
    FROM v_options WHERE domain <> 'IS' OR (documents IS NOT NULL AND trim(documents) <> '')""", ("v_options",))
def scan_all_domains(v):
    paths = [(k, _as_csv(v, _raw(v, k), k)) for k in DATASETS]
    paths.append(("math", fresh_path(v.spark, "never-written")))
    return R.load_all_domains(v.spark, paths).select(
        "domain", "domain_key", "prompt", "ground_truth", "documents", "options", "correct_index")


@query("scan_nested_json", "SELECT * FROM v_questions", ("v_questions",))
def scan_nested_json(v):
    path = fresh_path(v.spark, "nested")
    W.write_json(v.nested, path)
    return R.explode_questions(R.scan_nested(v.spark, path), F.col("doc"))


@query("consolidate_splits", """SELECT prompt AS question, ground_truth AS answer,
      CASE WHEN conv_id % 4 = 0 THEN 'test' ELSE 'train' END AS source FROM v_prompts""", ("v_prompts",))
def consolidate_splits(v):
    raw = v.prompts.select(F.col("prompt").alias("question"), F.col("ground_truth").alias("answer"),
                           (F.col("conv_id") % 4 == 0).alias("held_out"))
    parts = []
    for name, keep in (("train", ~F.col("held_out")), ("test", F.col("held_out"))):
        path = _as_csv(v, raw.filter(keep).drop("held_out"), name)
        parts.append(R.scan_csv(v.spark, "math", path).withColumn("source", F.lit(name)))
    return R.union_all(parts).select("question", "answer", "source")


def _sample_rows(v: Views):
    """Samples in the stored layout, with made-up failures and whole-text token counts."""
    failed = (F.col("conv_id") + F.col("sample_id")) % 11 == 0
    n = F.size(F.split("text", " ")).cast("bigint")
    return v.samples.select(
        "prompt_id", "sample_id", (0.7 + 0.075 * F.col("sample_id")).alias("temperature"),
        F.when(failed, "").otherwise(F.col("text")).alias("text"),
        F.when(F.col("conv_id") % 2 == 0, "small").otherwise("large").alias("model"),
        F.lit("local").alias("provider"),
        F.struct((F.col("conv_id") % 50 + 10).alias("prompt_tokens"), n.alias("completion_tokens"),
                 (F.col("conv_id") % 50 + 10 + n).alias("total_tokens")).alias("usage"),
        F.lit(None).cast("array<double>").alias("logprobs"),
        F.when(failed, "timeout").alias("error"))


@query("scan_samples", """SELECT p.prompt_id, p.domain, s.sample_id,
      CASE WHEN (s.conv_id + s.sample_id) % 11 = 0 THEN '' ELSE s.text END AS text
    FROM v_prompts p JOIN v_samples s USING (prompt_id)""", ("v_prompts", "v_samples"))
def scan_samples(v):
    path = fresh_path(v.spark, "samples")
    _sample_rows(v).write.parquet(path)
    stored = R.scan_samples(v.spark, path)
    return v.prompts.select("prompt_id", "domain").join(stored.select("prompt_id", "sample_id", "text"), "prompt_id")


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
           "benchmark", "labels", "conversations"]


@query("dataset_presence", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS n_rows, true AS found FROM {t}" for t in _TABLES)
    + " UNION ALL SELECT 'not_there', 0, false")
def dataset_presence(v):
    counted = R.union_all([v.table(t).agg(F.lit(t).alias("dataset"), F.count("*").alias("n")) for t in _TABLES])
    expected = v.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in [*_TABLES, "not_there"]])).alias("dataset"))
    return expected.join(counted, "dataset", "left").select(
        "dataset", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("n").isNotNull().alias("found"))


@query("sink_feature_matrix", """SELECT doc_id, domain, y, round(f_chars, 6) AS f_chars, round(f_words, 6) AS f_words,
      round(f_unique, 6) AS f_unique FROM v_features""", ("v_features",))
def sink_feature_matrix(v):
    path = fresh_path(v.spark, "features")
    W.write_features(v.features, path, "parquet", by=["domain"])
    return v.spark.read.parquet(path).select("doc_id", "domain", "y", *r6("f_chars", "f_words", "f_unique"))


@query("sink_tables", """SELECT prompt_id, domain, prompt, ground_truth FROM v_prompts""", ("v_prompts",))
def sink_tables(v):
    cols = v.prompts.select("prompt_id", "domain", "prompt", "ground_truth")
    path = _as_csv(v, cols, "table")
    return v.spark.read.schema(cols.schema).options(**R.CSV_OPTIONS).csv(path)


@query("sink_metrics_json", f"""WITH {_BUNDLE} SELECT model, domain, tp, round(auroc, 4) AS auroc, 20 AS arc_points,
    10 AS bins FROM bundle""", ("v_all_scored",))
def sink_metrics_json(v):
    cells = M.stored_cells(all_scored(v))
    docs = W.metrics_documents(M.bundle_of_cells(cells), M.arc_curve(cells), M.calibration_bins(cells), M.KEYS)
    path = fresh_path(v.spark, "metrics")
    W.write_json(docs, path)
    back = v.spark.read.schema("model string, domain string, document string").json(path)
    inner = F.from_json("document", "tp bigint, auroc double, arc array<struct<k:int>>, calibration array<struct<bin:int>>")
    return back.select("model", "domain", inner.alias("d")).select(
        "model", "domain", "d.tp", F.round("d.auroc", 4).alias("auroc"), F.size("d.arc").alias("arc_points"),
        F.size("d.calibration").alias("bins"))


@query("plot_tables", f"""WITH {_BUNDLE}
    SELECT 'arc' AS figure, model, domain, CAST(k AS DOUBLE) AS x, round(accuracy, 6) AS y FROM arc
    UNION ALL SELECT 'reliability', model, domain, round((lo + hi) / 2, 6), round(acc, 6) FROM bins
    UNION ALL SELECT 'bin_count', model, domain, round((lo + hi) / 2, 6), CAST(n AS DOUBLE) FROM bins
    UNION ALL SELECT 'matrix', model, domain, CAST(i AS DOUBLE), CAST([tn, fp, fn, tp][i + 1] AS DOUBLE)
      FROM bundle, (SELECT unnest(range(4)) AS i)
    UNION ALL SELECT 'domain_bar', model, domain, 0.0, auroc FROM bundle""", ("v_all_scored",))
def plot_tables(v):
    cells = M.stored_cells(all_scored(v))
    bundle = M.bundle_of_cells(cells)
    bins = M.calibration_bins(cells)

    def figure(name, df, x, y):
        return df.select(F.lit(name).alias("figure"), "model", "domain", x.cast("double").alias("x"),
                         y.cast("double").alias("y"))

    centre = F.round((F.col("lo") + F.col("hi")) / 2, 6)
    matrix = bundle.select("model", "domain", F.posexplode(F.array("tn", "fp", "fn", "tp")).alias("i", "n"))
    return R.union_all([
        figure("arc", M.arc_curve(cells), F.col("k"), F.round("accuracy", 6)),
        figure("reliability", bins, centre, F.round("acc", 6)), figure("bin_count", bins, centre, F.col("n")),
        figure("matrix", matrix, F.col("i"), F.col("n")),
        figure("domain_bar", bundle, F.lit(0.0), F.round("auroc", 6))])


# --- 2.2 projections, filters, profiles -------------------------------------

@query("standardize_columns", """SELECT prompt_id, 'Finance' AS domain, 'finance' AS domain_key, prompt, ground_truth, documents
    FROM v_options""", ("v_options",))
def standardize_columns(v):
    raw = v.options.select("prompt_id", F.lit("Finance").alias("domain"), F.lit("finance").alias("domain_key"),
                           F.col("prompt").alias("question"), F.col("ground_truth").alias("answer"),
                           F.col("documents").alias("context"))
    return R.standardize(raw, DATASETS["finance"])


@query("filter_prompt_not_null", """SELECT conv_id, turn, text AS prompt, role AS ground_truth FROM conversations WHERE role <> 'system'""")
def filter_prompt_not_null(v):
    raw = v.table("conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("question"), F.col("role").alias("answer"))
    kept = raw.filter(F.col("question").isNotNull())
    return kept.select("conv_id", "turn", F.col("question").alias("prompt"), F.col("answer").alias("ground_truth"))


@query("filter_truth_present", """SELECT domain, count(*) AS n_rows, count(*) FILTER (WHERE truth IS NOT NULL AND truth <> '') AS kept,
      round(100.0 * count(*) FILTER (WHERE truth IS NULL OR truth = '') / count(*), 6) AS dropped_pct
    FROM v_numeric GROUP BY domain""", ("v_numeric",))
def filter_truth_present(v):
    ok = F.col("truth").isNotNull() & (F.col("truth") != "")
    return v.numeric.groupBy("domain").agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("kept"),
        F.round(100.0 * F.count_if(~ok) / F.count("*"), 6).alias("dropped_pct"))


@query("filter_grounded_rows", """SELECT prompt_id, prompt, documents FROM v_options
    WHERE trim(prompt) <> '' AND documents IS NOT NULL AND trim(documents) <> ''""", ("v_options",))
def filter_grounded_rows(v):
    return R.preprocess(v.options.select("prompt_id", "prompt", "documents"), "is_agents")


@query("documents_alias", """SELECT prompt_id, coalesce(CASE WHEN conv_id % 2 = 0 THEN documents END, ground_truth) AS documents
    FROM v_options""", ("v_options",))
def documents_alias(v):
    raw = v.options.select("prompt_id", F.col("prompt").alias("question"), F.col("ground_truth").alias("answer"),
                           F.when(F.col("conv_id") % 2 == 0, F.col("documents")).alias("context"),
                           F.col("ground_truth").alias("documents"))
    return R.standardize(raw, DATASETS["finance"]).select("prompt_id", "documents")


@query("prompt_id_assign", f"""WITH numbered AS (
      SELECT *, {_KEY_SQL} || '_' || (row_number() OVER (PARTITION BY domain ORDER BY conv_id) - 1) AS pid FROM v_options)
    SELECT pid AS prompt_id, conv_id FROM numbered WHERE documents IS NOT NULL""", ("v_options",))
def prompt_id_assign(v):
    numbered = positions(v.options, ["domain"], [F.col("conv_id")], "place")
    named = R.prompt_ids(numbered.drop("prompt_id"), _key(F.col("domain")), "place")
    return named.filter(F.col("documents").isNotNull()).select("prompt_id", "conv_id")


@query("existing_label_cast", "SELECT doc_id, CAST(toxic = 1 AS INTEGER) AS existing_label FROM labels")
def existing_label_cast(v):
    from dataclasses import replace

    raw = v.table("labels").select(F.col("doc_id").cast("string").alias("prompt_id"),
                                   F.lit("?").alias("question"), F.lit("?").alias("answer"),
                                   (F.col("toxic") == 1).alias("hallucination_label"))
    spec = replace(DATASETS["is_agents"], has_labels=True)
    return R.standardize(raw, spec).select(F.col("prompt_id").cast("bigint").alias("doc_id"), "existing_label")


@query("gsm_answer_extract", """SELECT prompt_id, CASE WHEN conv_id % 3 = 0 THEN NULL
      WHEN conv_id % 3 = 1 THEN 'x ' || ground_truth ELSE CAST(conv_id AS VARCHAR) END AS answer FROM v_prompts""", ("v_prompts",))
def gsm_answer_extract(v):
    raw = (F.when(F.col("conv_id") % 3 == 0, F.lit(None))
           .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("x "), F.col("ground_truth")))
           .otherwise(F.concat("prompt", F.lit("#### 7 #### "), F.col("conv_id"), F.lit(" \n"))))
    return v.prompts.select("prompt_id", final_answer(raw).alias("answer"))


@query("schema_contract", """SELECT c AS "column", CASE c WHEN 'prompt' THEN count(*) FILTER (WHERE prompt IS NULL)
      WHEN 'ground_truth' THEN count(*) FILTER (WHERE ground_truth IS NULL) ELSE count(*) FILTER (WHERE documents IS NULL) END AS n_null,
      count(*) AS n_rows, count(*) >= 500 AS enough_rows
    FROM v_options, (SELECT unnest(['prompt', 'ground_truth', 'documents']) AS c) GROUP BY c""", ("v_options",))
def schema_contract(v):
    return profiling.schema_contract(v.options, ["prompt", "ground_truth", "documents"])


@query("column_prune", f"""SELECT prompt_id, domain, prompt, ground_truth, documents, options, correct_index FROM v_options""", ("v_options",))
def column_prune(v):
    return R.prune_columns(v.options)


@query("domain_filter", "SELECT prompt_id, prompt FROM v_prompts WHERE domain = 'Finance'", ("v_prompts",))
def domain_filter(v):
    return v.prompts.filter(F.col("domain") == "Finance").select("prompt_id", "prompt")


@query("table_profile", " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS n_null,
      {s} AS sample, count(*) AS n_rows, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS pct_null FROM v_options"""
    for i, (c, t, s) in enumerate([
        ("prompt_id", "string", "min(prompt_id)"), ("domain", "string", "min(domain)"),
        ("documents", "string", "min(documents)"), ("correct_index", "int", "CAST(min(correct_index) AS VARCHAR)")])),
    ("v_options",))
def table_profile(v):
    out = profiling.table_profile(v.options.select("prompt_id", "domain", "documents", "correct_index"))
    return out.select("position", "column", "type", "n_null", "sample", "n_rows", *r6("pct_null"))


@query("text_quality_profile", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE length(question) > 0) AS n_questions,
      count(*) FILTER (WHERE length(answer) > 0) AS n_answers, count(*) FILTER (WHERE length(context) > 100) AS n_contexts,
      round(avg(length(question)), 6) AS avg_question, round(avg(length(answer)), 6) AS avg_answer,
      round(avg(length(context)), 6) AS avg_context, count(*) >= 500 AS enough_rows,
      count(*) FILTER (WHERE length(question) > 0) = count(*) AS all_questions,
      count(*) FILTER (WHERE length(answer) > 0) = count(*) AS all_answers,
      count(*) FILTER (WHERE length(context) > 50) > count(*) * 0.95 AS has_context FROM v_questions""", ("v_questions",))
def text_quality_profile(v):
    q = R.explode_questions(v.nested, F.col("doc"))
    out = profiling.text_quality(q, "question", "answer", "context")
    flags = ["enough_rows", "all_questions", "all_answers", "has_context"]
    return out.select("n_rows", "n_questions", "n_answers", "n_contexts",
                      *r6("avg_question", "avg_answer", "avg_context"), *flags)


@query("answer_types", "SELECT answer_type, count(*) AS n FROM v_questions GROUP BY 1", ("v_questions",))
def answer_types(v):
    return profiling.value_counts(R.explode_questions(v.nested, F.col("doc")), "answer_type")


@query("length_histogram", r"""WITH m AS (
      SELECT unnest(['chars', 'words']) AS measure,
        unnest([CAST(length(text) AS DOUBLE), CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS DOUBLE)]) AS x
      FROM documents),
    e AS (SELECT measure, min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM m GROUP BY 1)
    SELECT measure, CAST(least(floor((x - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n, min(x) AS smallest, max(x) AS largest
    FROM m JOIN e USING (measure) GROUP BY ALL""")
def length_histogram(v):
    from riskloom.functions.text import words

    return profiling.length_histogram(v.table("documents"), {
        "chars": F.length("text"), "words": F.size(words(F.col("text")))})


# --- 2.3 prompt building ------------------------------------------------------

def _case(pairs, other):
    return "CASE domain " + " ".join(
        f"WHEN '{d}' THEN '{a}' || prompt || '{b}'" for d, (a, b) in pairs.items()) + f" ELSE {other} END"


@query("format_prompt", f"""SELECT prompt_id, prompt AS simple,
      {_case(P.INSTRUCTIONS, "'Question: ' || prompt || '\n\nAnswer:'")} AS instruction,
      CASE WHEN domain IN ('Medicine','Math','Finance','IS','Psychology') THEN prompt
           ELSE '<|user|>\n' || prompt || '\n<|assistant|>\n' END AS chat
    FROM (SELECT prompt_id, prompt, CASE WHEN conv_id % 7 = 0 THEN 'Law' ELSE domain END AS domain FROM v_prompts)""", ("v_prompts",))
def format_prompt(v):
    d = F.when(F.col("conv_id") % 7 == 0, "Law").otherwise(F.col("domain"))
    return v.prompts.select("prompt_id", *[P.format_prompt(F.col("prompt"), d, s).alias(s)
                                           for s in ("simple", "instruction", "chat")])


@query("format_mcq", f"""SELECT prompt_id, '{P.MCQ_HEAD}' || 'Question: ' || prompt || '\n' || 'A) ' || string_split(ground_truth, ' ')[2] || '\n'
      || 'B) ' || string_split(ground_truth, ' ')[1] || '\n' || 'C) none\n' || '\nAnswer:' AS formatted_prompt FROM v_options""", ("v_options",))
def format_mcq(v):
    return v.options.select("prompt_id", P.format_prompt(
        F.col("prompt"), F.lit("Medicine"), options=P.parse_options(F.col("options"))).alias("formatted_prompt"))


@query("format_grounded", f"""SELECT prompt_id, CASE WHEN domain IN ('Finance', 'IS') AND length(documents) > 0 THEN
      '{P.GROUNDED_HEAD}' || 'Context: ' || documents || '\n\nQuestion: ' || prompt || '\n\nAnswer:' ELSE prompt END AS formatted_prompt
    FROM v_options""", ("v_options",))
def format_grounded(v):
    return v.options.select("prompt_id", P.format_prompt(
        F.col("prompt"), F.col("domain"), documents=F.col("documents")).alias("formatted_prompt"))


@query("chat_messages", """SELECT prompt_id, i AS position, CASE WHEN has AND i = 0 THEN 'system' ELSE 'user' END AS role,
      CASE WHEN has AND i = 0 THEN 'Be brief.' ELSE prompt END AS content
    FROM (SELECT prompt_id, prompt, conv_id % 2 = 0 AS has FROM v_prompts) p, (SELECT CAST(unnest(range(2)) AS INTEGER) AS i)
    WHERE has OR i = 0""", ("v_prompts",))
def chat_messages(v):
    system = F.when(F.col("conv_id") % 2 == 0, "Be brief.").otherwise("")
    return v.prompts.select("prompt_id", F.posexplode(P.chat_messages(F.col("prompt"), system)).alias("position", "m")) \
        .select("prompt_id", "position", "m.role", "m.content")


@query("table_to_text", "SELECT doc, table_text FROM v_docs", ("v_docs",))
def table_to_text(v):
    return v.nested.select("doc", P.table_text(F.col("table.table")).alias("table_text"))


@query("paragraphs_to_text", "SELECT doc, para_text FROM v_docs", ("v_docs",))
def paragraphs_to_text(v):
    return v.nested.select("doc", P.paragraphs_text(F.col("paragraphs")).alias("para_text"))


@query("context_build", """SELECT doc, CASE WHEN length(para_text) % 2 = 0 THEN para_text || chr(10) || chr(10) ELSE '' END
      || 'TABLE:' || chr(10) || table_text AS context FROM v_docs""", ("v_docs",))
def context_build(v):
    shown = F.when(F.length(P.paragraphs_text(F.col("paragraphs"))) % 2 == 0, F.col("paragraphs"))
    return v.nested.select("doc", P.context_text(shown, F.col("table.table")).alias("context"))


@query("questions_explode", "SELECT id, question, answer, context, table_uid, answer_type FROM v_questions", ("v_questions",))
def questions_explode(v):
    return R.explode_questions(v.nested, F.col("doc"))
