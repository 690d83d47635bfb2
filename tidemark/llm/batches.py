"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of one Arrow batch; texts are a few kB each, so a batch is a few MB.
BATCH_ROWS = 500


_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batch_rows(spark, rows: int):
    """Plans that run within have Arrow batches of at most ``rows`` rows; the session's own setting returns."""
    before = spark.conf.get(_ROWS_KEY)
    spark.conf.set(_ROWS_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_KEY, before)


def release_memory() -> None:
    """Gives freed memory of a reused worker back to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """``make()`` runs once per task and returns the function that turns a batch into columns. A session
    that keeps Spark's default number of rows in a batch gets a smaller one; any other number stays."""
    if df.sparkSession.conf.get(_ROWS_KEY) == "10000":
        df.sparkSession.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, n = None, 0
        for batch in batches:
            work = work or make()
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch), schema=arrow)
                n += 1
        if n > 3:
            del work, batch
            release_memory()

    return df.mapInArrow(run, schema)


def same_columns(df: DataFrame) -> str:
    """The schema of ``df`` as text."""
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def strings(column: pa.Array) -> list[str | None]:
    """A text column as strings; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [b if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null is the empty text."""
    return [t or "" for t in strings(batch.column(name))]


def held_out():
    """True for documents whose labels and languages may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
