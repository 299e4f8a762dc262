"""What the operators share: tables in the folder that the cluster shares, and small batches and freed memory of Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.settle import drop_settled, settle, shared_folder

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 rows go to Python workers from now on, as rows hold whole texts: Spark's own 10,000 take hundreds of MB in
    each task, on both sides. A session that was set to another number keeps it."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def free_unused() -> None:
    """Gives the system the memory that Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows``, after which a task's worker has no more memory than it uses: it waits for its next task while the JVM works at joins,
    and both count against the executor."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        free_unused()

    return freed


def settle_alone(df: DataFrame) -> DataFrame:
    """``settle(df)``, whose shuffle files are deleted as soon as it is written: nothing else reads them."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return settle(df)
    finally:
        spark.conf.set(CLEANUP, before)


__all__ = ["drop_settled", "free_unused", "lean", "settle", "settle_alone", "shared_folder", "small_batches"]
