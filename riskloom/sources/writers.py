"""Sinks.  Writers never pull rows to the driver; each task writes its part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# blanks at the ends of a text are data
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_features(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Feature matrix as parquet, csv or (for feather) parquet, optionally by domain."""
    if fmt not in ("parquet", "csv", "feather"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.partitionBy(*by) if by else df.write
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def metrics_documents(bundle: DataFrame, arc: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per set with the scalars and the two curves of fixed length.

    ROC curves grow with the number of distinct scores; write those as a table.
    """
    def gathered(df: DataFrame, order: str, name: str, cols: list[str]) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct(order, *cols)))
        return df.groupBy(*keys).agg(rows.alias(name))

    joined = (bundle.join(gathered(arc, "k", "arc", ["rejection_rate", "accuracy"]), keys)
              .join(gathered(bins, "bin", "calibration", ["acc", "conf", "n"]), keys))
    body = [c for c in joined.columns if c not in keys]
    return joined.select(*keys, F.to_json(F.struct(*body)).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
