"""Small session helpers of the text operators."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches hold at most so many bytes, so that a batch of long documents stays small.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, str(1 << 30))).rstrip("bB")
    if now.isdigit() and int(now) > most:
        spark.conf.set(key, str(most))


def fold(id_column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: which fold a row belongs to. Null ids count as fold 0."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a DataFrame.

    They go to the JVM as Arrow: rows of Python objects would go through RDDs, whose Python daemon and workers
    every executor would hold beside those of Arrow functions.
    """
    names = T.StructType.fromDDL(schema).names
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(list(c)) for c in columns], names=names), schema)


def give_back() -> None:
    """Memory that is free in this worker goes back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state: make() is called once a task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                del out
                pa.default_memory_pool().release_unused()
        del f
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def crc32_text(value: object) -> int:
    return zlib.crc32(str(value).encode())
