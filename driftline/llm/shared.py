"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import keep_columnar, ship_package

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"  # what separates words; all other characters belong to words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal doc_id modulo a divisor; null ids have no remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def ready(df: DataFrame) -> SparkSession:
    """The session, with this package on the executors' path."""
    ship_package(df.sparkSession)
    return df.sparkSession


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files."""
    return keep_columnar(df)


_kept_between_tasks: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What this Python worker keeps between the tasks of one operator; a task of another operator drops it.

    Spark gives a worker to the tasks of all stages, so what one stage has kept would be held through the next ones.
    """
    if others := [name for name in _kept_between_tasks if name != operator]:
        for name in others:
            del _kept_between_tasks[name]
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _kept_between_tasks.setdefault(operator, {})


def drop_unused_shuffles(spark: SparkSession) -> None:
    """Let the driver's collector run, so that Spark's cleaner removes shuffle files that no DataFrame needs any more.

    Spark does the same by itself every ``spark.cleaner.periodicGC.interval``, by default half an hour: too late
    where one query writes several large tables, one after the other.
    """
    for _ in range(2):  # the first run frees the DataFrames, the second one what they held
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        time.sleep(0.5)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
