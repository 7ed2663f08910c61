"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null gives none."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x.decode("utf-8", "replace") for x in text_bytes(batch, name)]


def slices(batch: pa.RecordBatch, name: str, most_bytes: int):
    """Runs of rows whose texts have about ``most_bytes`` together; a longer text stands alone."""
    begin, held = 0, 0
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin, len(sizes) - begin)


#: Bytes of text that are worked on at once.
SLICE = 4_000_000

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
          "binary": pa.binary()}
_SPARK = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(),
          "double": T.DoubleType(), "binary": T.BinaryType()}


def row_wise(rows: DataFrame, keep: list[str], text: str, new: dict[str, str], compute) -> DataFrame:
    """``keep`` columns of each row followed by ``new`` ones (name to type) computed from its text.

    ``compute`` gets an iterator of record batches and yields, for each, a list of
    value lists in the order of ``new``.  Rows are neither joined nor moved, so repeated and
    null ids need no care.  Batches go through in slices of a few MB.
    A kept column that bears the name of a new one gives way to it.
    """
    keep = [c for c in keep if c not in new]
    carried = rows.select(*[rows[f"`{c}`"] for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([carried.schema[c] for c in keep] + [T.StructField(n, _SPARK[k]) for n, k in new.items()])
    names, kinds = [*keep, *new], list(new.values())

    def run(batches):
        held = []

        def taken():
            for whole in batches:
                for batch in slices(whole, text, SLICE):
                    held.append(batch)
                    yield batch

        for values in compute(taken()):
            batch = held.pop(0)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(v, _ARROW[k]) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return carried.mapInArrow(run, schema)
