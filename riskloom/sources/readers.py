"""Raw dataset tables: CSV per domain, nested JSON, stored samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import DATASETS, DatasetSpec
from riskloom.functions.numbers import final_answer
from riskloom.functions.prompts import context_text
from riskloom.functions.text import strip
from riskloom.sources.records import csv_records, json_array_records

# For Spark's own reader, which reads a file of such records whole in one task.
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}

_S = T.StringType()
RAW_SCHEMAS = {
    "medicine": T.StructType([T.StructField("question", _S), T.StructField("correct_answer", _S),
                              T.StructField("options", _S), T.StructField("correct_index", T.IntegerType())]),
    "math": T.StructType([T.StructField("question", _S), T.StructField("answer", _S)]),
    "finance": T.StructType([T.StructField("id", _S), T.StructField("question", _S), T.StructField("answer", _S),
                             T.StructField("context", _S), T.StructField("table_uid", _S),
                             T.StructField("answer_type", _S)]),
    "is_agents": T.StructType([T.StructField("question", _S), T.StructField("answer", _S),
                               T.StructField("documents", _S)]),
    "psychology": T.StructType([T.StructField("Question", _S), T.StructField("Best Answer", _S)]),
}
NESTED_SCHEMA = T.StructType([
    T.StructField("doc", _S),
    T.StructField("table", T.StructType([
        T.StructField("uid", _S), T.StructField("table", T.ArrayType(T.ArrayType(_S)))])),
    T.StructField("paragraphs", T.ArrayType(T.StructType([
        T.StructField("order", T.IntegerType()), T.StructField("text", _S)]))),
    T.StructField("questions", T.ArrayType(T.StructType([
        T.StructField("question", _S), T.StructField("answer", _S), T.StructField("answer_type", _S)]))),
])
SAMPLES_SCHEMA = T.StructType([
    T.StructField("prompt_id", _S), T.StructField("sample_id", T.LongType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("text", _S),
    T.StructField("model", _S), T.StructField("provider", _S),
    T.StructField("usage", T.StructType([
        T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType())])),
    T.StructField("logprobs", T.ArrayType(T.DoubleType())), T.StructField("error", _S),
    T.StructField("top_logprobs", T.ArrayType(T.MapType(_S, T.DoubleType()))),
])


def spec_of(key: str) -> DatasetSpec:
    try:
        return DATASETS[key]
    except KeyError:
        raise ValueError(f"unknown dataset {key!r}; known: {sorted(DATASETS)}") from None


def scan_csv(spark: SparkSession, key: str, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One domain's CSV with ``domain`` and ``domain_key`` stamped on; a file is read by many tasks, newlines in texts or not."""
    spec_of(key)
    return _stamped(csv_records(spark, path, schema or RAW_SCHEMAS[key]).drop("file", "record"), key)


def _stamped(raw: DataFrame, key: str) -> DataFrame:
    return raw.withColumn("domain", F.lit(spec_of(key).domain)).withColumn("domain_key", F.lit(key))


def record_position(records: DataFrame, name: str = "position") -> DataFrame:
    """Place of each record over all files in the order of their names; the window sees one row a file."""
    counts = records.groupBy(F.col("file").alias("_file")).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    return records.join(offsets, records["file"] == offsets["_file"]).withColumn(name, F.col("_off") + F.col("record")).drop("_file", "_off", "file", "record")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask Spark's own file listing, so any supported file system works."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", True)
                    .load(path).select("path").take(1))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def standardize(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Map a dataset's columns to ``prompt``, ``ground_truth`` and friends; NULL prompts go."""
    need = [spec.prompt_column, spec.answer_column]
    absent = [c for c in need if c not in df.columns]
    if absent:
        raise ValueError(f"{spec.key}: mapped columns not in the table: {absent}")
    out = {"prompt": F.col(f"`{spec.prompt_column}`"), "ground_truth": F.col(f"`{spec.answer_column}`")}
    if spec.documents_column:
        docs = [c for c in (spec.documents_column, "context", "documents") if c in df.columns]
        if docs:
            out["documents"] = F.coalesce(*[F.col(c) for c in dict.fromkeys(docs)])
    if spec.has_labels and spec.label_column in df.columns:
        out["existing_label"] = F.col(spec.label_column).cast("int")
    for extra in spec.extra_columns:
        if extra in df.columns:
            out[extra] = F.col(extra)
    keep = [c for c in ("prompt_id", "domain", "domain_key") if c in df.columns]
    return df.select(*keep, *[c.alias(n) for n, c in out.items()]).filter(F.col("prompt").isNotNull())


def filled(text: Column) -> Column:
    return text.isNotNull() & (strip(text) != "")


PREPROCESS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "medicine": lambda df: df.filter(F.col("ground_truth").isNotNull() & (F.col("ground_truth") != "")),
    "math": lambda df: df.withColumn("ground_truth", final_answer(F.col("ground_truth"))),
    "is_agents": lambda df: df.filter(filled(F.col("prompt"))).filter(filled(F.col("documents"))),
}


def preprocess(df: DataFrame, key: str) -> DataFrame:
    return PREPROCESS.get(key, lambda d: d)(df)


def with_row_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Number rows in scan order without a sort: per-partition counts give the offsets.

    The count table has one row per scan partition.  Only sound on a scan, whose
    partitions are the same each time it runs; prefer a natural key.
    """
    tagged = df.withColumn("_mono", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_mono"), 33)
    tagged = tagged.withColumn("_part", part).withColumn("_in", F.col("_mono") - F.shiftleft(part, 33))
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    return (tagged.join(offsets, "_part")
            .withColumn(name, F.col("_off") + F.col("_in")).drop("_part", "_in", "_mono", "_off"))


def prompt_ids(df: DataFrame, domain_key: Column, position: str) -> DataFrame:
    return df.withColumn("prompt_id", F.concat_ws("_", domain_key, F.col(position).cast("string")))


def load_domain(spark: SparkSession, key: str, path: str) -> DataFrame:
    """Scan, number, standardise and preprocess one domain.

    Numbers follow the records of the files, whatever the splits they are read in.
    """
    spec_of(key)
    raw = _stamped(record_position(csv_records(spark, path, RAW_SCHEMAS[key])), key)
    return preprocess(standardize(prompt_ids(raw, F.lit(key), "position"), spec_of(key)), key)


def load_all_domains(spark: SparkSession, paths: list[tuple[str, str]]) -> DataFrame:
    """Union of the (dataset, path) pairs whose files exist; the rest are skipped."""
    frames = [load_domain(spark, k, p) for k, p in paths if path_exists(spark, p)]
    if not frames:
        raise ValueError("no dataset file found")
    return union_all(frames)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_nested(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested documents with the name of their file."""
    return (spark.read.schema(NESTED_SCHEMA).option("multiLine", multi_line).json(path)
            .withColumn("file_name", F.col("_metadata.file_name")))


def scan_nested_arrays(spark: SparkSession, path: str, name: str = "doc_id") -> DataFrame:
    """Files of one JSON array each, read by many tasks; ``{file stem}_doc{i}`` by place in the array.

    Files of equal names in several folders would give equal ids, so that raises.
    """
    records = json_array_records(spark, path, NESTED_SCHEMA)
    names = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("n"))
    twice = names.groupBy("n").count().filter("count > 1").select("n").take(1)
    if twice:
        raise ValueError(f"several files are named {twice[0].n!r}")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return records.withColumn(name, F.concat(stem, F.lit("_doc"), F.col("record"))).drop("record")


def number_documents(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """``{file stem}_doc{i}`` by place in the file.

    A file of one JSON array is read in order by one task, so the place is the
    distance from the file's first row; one small count per file, no sort.
    """
    tagged = docs.withColumn("_mono", F.monotonically_increasing_id())
    first = tagged.groupBy("file_name").agg(F.min("_mono").alias("_first"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return tagged.join(first, "file_name").withColumn(
        name, F.concat(stem, F.lit("_doc"), F.col("_mono") - F.col("_first"))).drop("_mono", "_first")


def explode_questions(docs: DataFrame, doc_id: Column) -> DataFrame:
    """One row per question; every question of a document shares its context."""
    built = docs.select(doc_id.alias("doc_id"),
                        context_text(F.col("paragraphs"), F.col("table.table")).alias("context"),
                        F.coalesce(F.col("table.uid"), F.lit("")).alias("table_uid"), "questions")
    return built.select("doc_id", "context", "table_uid", F.posexplode("questions").alias("q_idx", "q")).select(
        F.concat(F.col("doc_id"), F.lit("_q"), F.col("q_idx")).alias("id"),
        F.coalesce(F.col("q.question"), F.lit("")).alias("question"),
        F.coalesce(F.col("q.answer"), F.lit("")).alias("answer"), "context", "table_uid",
        F.coalesce(F.col("q.answer_type"), F.lit("")).alias("answer_type"))


def scan_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES_SCHEMA).parquet(path)


PROCESSED_COLUMNS = ["prompt_id", "domain", "domain_key", "prompt", "formatted_prompt", "ground_truth",
                     "documents", "existing_label", "options", "correct_index"]


def prune_columns(df: DataFrame, wanted: list[str] = PROCESSED_COLUMNS) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])
