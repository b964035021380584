"""Python workers that serve one stage after the other."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return freed memory to the system: a worker that waits, or goes on to other work, should not hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, a function for `mapInArrow`, that gives memory back when its partition ends."""
    def whole(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(frames)
        finally:
            give_back()

    return whole


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand at most so many rows at a time to Python: whole texts are long rows. The session's own
    setting comes back after."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
