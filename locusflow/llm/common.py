"""Plumbing shared by the text operators.

Intermediate results that are read more than once are written as Parquet into
the shared folder named by ``spark.checkpoint.dir``, so a lost executor costs a
re-read and no lineage has to be replayed.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only by local masters that name no shared folder (tests, bench).
LOCAL_SHARED = "file:///tmp/checkpoints/locusflow"

#: Tables of so many rows at most (of a few numbers each, 16 MB in all) are broadcast, or worked on by one task.
SMALL = 1 << 17

#: Tables that materialise() wrote, by their DataFrame's id (which stays taken while the frame is held here).
_written: dict[int, tuple[DataFrame, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; an unset one is an error off local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_SHARED
    return root.rstrip("/")


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    by: a last column whose values get folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[id(table)] = (table, path)
    return table


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run meanwhile sends batches of so many rows at most to Python, so that little of long texts is held at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(had)) if int(had) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def is_small(table: DataFrame, rows: int = SMALL) -> bool:
    """Whether a written table has so many rows at most (the files' footers tell)."""
    return table.count() <= rows


def light(table: DataFrame, rows: int = SMALL) -> DataFrame:
    """The written table, to be broadcast if it is small; else joined by a shuffle."""
    return F.broadcast(table) if is_small(table, rows) else table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for table in tables:
        held, path = _written.pop(id(table))
        _delete(held.sparkSession, path)


def release_all() -> None:
    """Delete every table that materialise() wrote and that is left."""
    while _written:
        _, (table, path) = _written.popitem()
        with contextlib.suppress(Exception):  # the session may be gone by now; the others are still tried
            _delete(table.sparkSession, path)


atexit.register(release_all)


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_ranges(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """df written in range partitions of the order, their number in a column part.

    Rows that are equal in the order share a partition: let its last column tell rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), label)


def running_totals(df: DataFrame, value: str, name: str, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """df of in_ranges() with a column name: the sum of value over the rows before each one (of the same by).

    Rows are summed within their partition; only the partitions' sums are ordered in one place.
    The ranges' order begins with by.
    """
    sums = df.groupBy(*by, "part").agg(F.sum(value).alias("__lf_sum"))
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.select(*by, "part", F.coalesce(F.sum("__lf_sum").over(ahead), F.lit(0)).alias("__lf_base")), "running-totals")
    within = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("__lf_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    met = summed.join(light(sums), [*by, "part"])
    return met.withColumn(name, F.col("__lf_own") + F.col("__lf_base")).drop("__lf_own", "__lf_base")


def portions(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and of about so many bytes of a text column at most, a longer text by itself."""
    offsets = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = max(at + 1, min(end, at + rows, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), vectorised over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class BoundedCache:
    """A two-generation memo: at most 2 * limit entries, recent ones are kept."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def age(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
