"""Records that span lines, read by many tasks.

A file is read in the pieces that its splits happen to have; a piece alone doesn't say whether it begins inside
a quoted field or a nested object.  What each piece does to that state is counted, running totals over the pieces of a
file (see ``operators.ranking``) give the state before each one, and with it where records begin.  Only the pieces of
one record are ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.ranking import cut_order, running_totals

_ORDER = ["block", "at"]


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, block, at, value: the text between separators, in file order by (block, at)."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _joined(pieces: DataFrame, record: str, separator: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*_ORDER, "value")))
    return pieces.groupBy("file", "file_name", record).agg(F.array_join(F.transform(parts, lambda p: p["value"]), separator).alias("text"))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def csv_records(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """The schema's columns, ``file`` and ``record`` (from 0, in file order; blank lines don't count) of quoted CSV.

    Quotes inside a field are doubled.  A record begins where an even number of quotes lies ahead of a line.
    """
    order = [F.col(c) for c in _ORDER]
    lines = _pieces(spark, path, "\n").withColumn("quotes", _count(F.col("value"), '"'))
    lines, cut = cut_order(lines, ["file"], order)
    known = running_totals(lines, ["file"], order, {"quotes": F.col("quotes")}, cut)
    begins = (F.col("cum_quotes") - F.col("quotes")) % 2 == 0
    known = known.filter(~(begins & F.col("value").isin("", "\r")))
    known = known.select("file", "file_name", *_ORDER, "value", "_run", begins.cast("int").alias("begins"))
    numbered = running_totals(known, ["file"], order, {"record": F.col("begins")}, cut)
    whole = _joined(numbered.withColumn("record", F.col("cum_record") - (2 if header else 1)), "record", "\n")
    whole = whole.filter("record >= 0").withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    fields = F.from_csv("text", _ddl(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    return whole.select(fields.alias("_f"), "file", "record").select("_f.*", "file", "record")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def json_array_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns, ``file_name`` and ``record`` (from 0) of files that hold one JSON array of objects, or objects in a row.

    Files are cut at closing braces.  First the quotes that aren't escaped tell which pieces begin inside a string, then
    the braces outside strings tell where an object of the array ends.
    """
    order = [F.col(c) for c in _ORDER]
    bare = F.regexp_replace("value", r"\\(?s:.)", "")
    pieces = _pieces(spark, path, "}").withColumn("quotes", _count(bare, '"'))
    pieces, cut = cut_order(pieces, ["file"], order)
    known = running_totals(pieces, ["file"], order, {"quotes": F.col("quotes")}, cut)
    inside = (F.col("cum_quotes") - F.col("quotes")) % 2 == 1
    # what stands outside strings: complete ones go, then one that is still open at the end
    text = F.when(inside, F.concat(F.lit('"'), bare)).otherwise(bare)
    outside = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '"[^"]*\\z', "")
    closes = F.when(F.col("cum_quotes") % 2 == 0, 1).otherwise(0)
    known = known.select("file", "file_name", *_ORDER, "value", "_run", (_count(outside, "{") - closes).alias("depth"), closes.alias("closes"))
    deep = running_totals(known, ["file"], order, {"depth": F.col("depth")}, cut)
    ends = ((F.col("cum_depth") == 0) & (F.col("closes") == 1)).cast("int")
    deep = deep.select("file", "file_name", *_ORDER, "value", "_run", ends.alias("ends"))
    numbered = running_totals(deep, ["file"], order, {"record": F.col("ends")}, cut)
    whole = _joined(numbered.withColumn("record", F.col("cum_record") - F.col("ends")), "record", "}")
    whole = whole.withColumn("text", F.regexp_replace("text", r"\A[\s,\[\]]+", "")).filter(F.startswith("text", F.lit("{")))
    return whole.select(F.from_json(F.concat("text", F.lit("}")), schema).alias("_f"), "file_name", "record").select("_f.*", "file_name", "record")
