"""Anchored windows of many streams at once, with the open window of each stream as keyed state."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from burstline.operators.windows import epoch_second, window_length

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ADDED = [("window_id", T.LongType()), ("window_seq", T.LongType()), ("block", T.LongType()), ("place", T.LongType()),
          ("trigger", T.BooleanType())]


class AnchoredWindows(StatefulProcessor):
    """Value state of a stream: start and number of the window that is open."""

    def __init__(self, columns: list[str], length: int, history_windows: int) -> None:
        self._columns = columns
        self._length = length
        self._history = history_windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "anchor long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # names that are no identifiers do not survive the way here
        posts = pd.concat([f.set_axis(self._columns, axis=1) for f in rows], ignore_index=True)
        posts = posts.sort_values(["ts", "post_id"], ignore_index=True)
        before = self._open.get() if self._open.exists() else None
        second = posts.pop("_second").to_numpy()
        if before is not None:  # older posts join the open window
            second = np.maximum(second, before[0])
        starts = [] if before is None else [int(before[0])]
        at = 0 if before is None else int(np.searchsorted(second, starts[0] + self._length))
        while at < len(second):
            starts.append(int(second[at]))
            at = int(np.searchsorted(second, starts[-1] + self._length))
        first = int(before[1]) if before is not None else 1
        self._open.update((starts[-1], first + len(starts) - 1))

        window = np.searchsorted(starts, second, side="right") - 1
        seq = first + window
        opens = np.diff(window, prepend=-1 if before is None else 0) > 0
        yield posts.assign(window_id=np.array(starts)[window], window_seq=seq, block=(seq - 1) // self._history,
                           place=(seq - 1) % self._history + 1, trigger=opens & (seq > 1))

    def close(self) -> None:
        pass


def anchored_stream(posts: DataFrame, minutes: float, by: str, history_windows: int = 4) -> DataFrame:
    """Posts of a stream with their anchored window, per value of column `by`.

    As `operators.windows.anchored_windows`, `window_sequence` and `with_trigger` with `by`: adds window_id, window_seq,
    block, place (the history starts afresh after `history_windows` windows) and trigger. A post that comes in after
    a later window has opened joins the open window. State holds two numbers a stream and outlives
    restarts with the checkpoint.

    The posts of one stream in one micro-batch are sorted in one task: bound the micro-batch (`max_files`).
    Needs the RocksDB state store, see `rocksdb_state`.
    """
    schema = T.StructType([*posts.schema.fields, *[T.StructField(n, t) for n, t in _ADDED]])
    timed = posts.withColumn("_second", epoch_second(F.col("ts")))
    return timed.groupBy(by).transformWithStateInPandas(
        statefulProcessor=AnchoredWindows(timed.columns, window_length(minutes), history_windows), outputStructType=schema,
        outputMode="Append", timeMode="None")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
