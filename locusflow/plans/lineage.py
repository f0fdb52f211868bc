"""Cutting lineage in loops, and folders for files that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of so many rows of a few numbers each (some megabytes) may be broadcast.
SMALL = 1 << 17

_folders: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; an unset one is an error off local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or "file:///tmp/checkpoints/locusflow").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed into the folder of spark.checkpoint.dir that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def light(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, checkpointed and counted, to be broadcast if it has so few rows; else joined by a shuffle."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= rows else held


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; it is deleted when the interpreter ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there by all that use it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_folders() -> None:
    for spark, path in _folders:
        with contextlib.suppress(Exception):  # the session may be gone by now; the others are still tried
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
