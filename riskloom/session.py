"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings for large inputs.  Start with many shuffle partitions and let adaptive
# execution merge small ones and split those of a hot key, even where splitting
# a join costs another shuffle.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256MB",
}


def configure(spark: SparkSession, **overrides: str) -> SparkSession:
    """Apply ``SCALE_CONF`` to a running session; keyword names use _ for the dots."""
    settings = {**SCALE_CONF, **{k.replace("_", "."): v for k, v in overrides.items()}}
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "riskloom", cores: str = "8") -> SparkSession:
    """A session for tests and the bench; on a cluster use the one you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # small tables with costly rows should still use every core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder, since its executors share this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = getattr(spark, "_riskloom_dir", None)
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="riskloom-")
        spark._riskloom_dir = fallback
    return fallback


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return os.path.join(shared_dir(spark), f"{stem}-{uuid.uuid4().hex}")


def materialize(df, stem: str = "stage"):
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that outlives lost executors.
    """
    path = fresh_path(df.sparkSession, stem)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._riskloom_stored = True
    return stored


def is_stored(df) -> bool:
    """Whether ``df`` is just what ``materialize`` returned, so that reading it again computes nothing again."""
    return getattr(df, "_riskloom_stored", False)


def drop_stage(df) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
