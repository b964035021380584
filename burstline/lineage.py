"""Cutting lineage: write a step to the folder all executors share, and go on from the written table.

A lost executor then never replays a loop, later plans start from a plain scan with true sizes, and
several readers share one result.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local: tempfile.TemporaryDirectory | None = None
_written: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only for local sessions without it."""
    global _local
    sc = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
              or sc.getCheckpointDir())
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.TemporaryDirectory(prefix="burstline-", ignore_cleanup_errors=True)
    return _local.name


def cut(df: DataFrame) -> DataFrame:
    """Write `df` out once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/burstline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete what `cut` wrote for these tables, once nothing reads them any more."""
    for table in tables:
        path = _path_of.pop(table)
        _written.remove(path)
        delete_folder(table.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whichever file system it lies; nothing happens if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def written_tables_freed(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what `cut` wrote inside: for jobs that have stored their result by then."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            delete_folder(spark, path)
        del _written[before:]
