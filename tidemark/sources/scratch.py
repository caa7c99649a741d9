"""Tables and folders that a plan writes for itself, where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder takes its place only in a local session that has none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def hold(df: DataFrame) -> DataFrame:
    """A small table, written once, so that what it is made from is not read again at every use."""
    return written(df.coalesce(1), "held")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table of any size, written once as Parquet; columns and filters of its readers reach the files."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> DataFrame:
    """A table written in buckets of its key, sorted within each: tables of one key and number of buckets join without an exchange."""
    spark = df.sparkSession
    path = fresh(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    # One task a bucket, so that a bucket is one file and stays sorted.
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


_once: dict[tuple[str, str, str], object] = {}


def remembered(spark: SparkSession, name: str, source: str, make: Callable[[], T]) -> T:
    """What `make` gives, made on the first call for a source in an application; sources are taken not to change while it runs."""
    key = spark.sparkContext.applicationId, name, source
    if key not in _once:
        _once[key] = make()
    return _once[key]


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A remembered table: written on the first call, read by all later ones."""
    return remembered(spark, name, source, lambda: written(make(), name))
