"""Staged tables: lineage is cut by writing Parquet into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Rows up to which a table may be broadcast; a check of the count stands before every broadcast.
BROADCAST_ROWS = 100_000

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="linkwright-")
    return _local[app]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for a path, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return bool(fs.exists(where))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in whatever store the path is; folders above it are made."""
    fs, where = file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/linkwright/{name}-{uuid.uuid4().hex}"
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files that outlive executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    fs, where = file_system(df.sparkSession, df._staged_path)
    fs.delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged (cheap to count) table for broadcast if it has no more than that many rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
