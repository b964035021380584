"""Fixed-length windows over event time.

Every function works on whole seconds of `ts` and adds `window_id`, the epoch second at which the
window starts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.lineage import cut

# anchored windows are resolved in stretches of about this many seconds, at least 64 windows
_STRETCH_SECONDS = 262_144
# streams share tasks up to about so many distinct seconds of a stretch
_TASK_SECONDS = 262_144


def epoch_second(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def window_start(window_id: Column) -> Column:
    return F.timestamp_seconds(window_id)


def window_label(window_id: Column) -> Column:
    return F.date_format(window_start(window_id), "dd-MM-yyyy HH:mm")


def window_length(minutes: float) -> int:
    """Window length in seconds: `age < minutes * 60` on whole seconds."""
    return math.ceil(minutes * 60)


def aligned_windows(posts: DataFrame, minutes: float) -> DataFrame:
    """Windows aligned to the epoch. No shuffle: the id is a projection of `ts`."""
    length = window_length(minutes)
    second = epoch_second(F.col("ts"))
    return posts.withColumn("window_id", second - F.pmod(second, F.lit(length)))


def _stream(by: str | None) -> Column:
    """The stream of a row as text, so that rows without a key are a stream of their own; one stream without `by`."""
    return F.to_json(F.struct(by)) if by else F.lit("")


def anchored_windows(posts: DataFrame, minutes: float, open_anchor: int | None = None, by: str | None = None) -> DataFrame:
    """Windows that start at the first post at or after the end of the one before.

    With `by`, the posts of each value of that column are a stream with windows of its own.
    `open_anchor` continues an earlier run of one stream: the start of the window still open then. Posts
    older than it join that window.
    """
    second = epoch_second(F.col("ts"))
    if open_anchor is not None:
        second = F.greatest(second, F.lit(open_anchor))
    length = window_length(minutes)
    timed = posts.withColumns({"_u": second, "_stream": _stream(by)})
    seconds = timed.select("_stream", F.col("_u").alias("u")).distinct()
    if open_anchor is not None:
        opened = posts.sparkSession.range(open_anchor, open_anchor + 1).select(F.lit("").alias("_stream"), F.col("id").alias("u"))
        seconds = seconds.union(opened).distinct()
    # a post lies less than one length after the start of its window, so the start falls into the
    # same length-sized slot of the time line or the one before; slots hold one start at most
    starts = cut(anchored_starts(seconds, length))  # one row per window, read by every later step
    slots = starts.select("_stream", "window_id", F.explode(F.array(
        F.floor(F.col("window_id") / length), F.floor(F.col("window_id") / length) + 1)).alias("_slot"))
    return (timed.withColumn("_slot", F.floor(F.col("_u") / length)).join(slots, ["_stream", "_slot"])
            .filter((F.col("_u") >= F.col("window_id")) & (F.col("_u") < F.col("window_id") + length))
            .drop("_u", "_slot", "_stream"))


def anchored_starts(seconds: DataFrame, length: int) -> DataFrame:
    """Starts (_stream, window_id) of the anchored windows over distinct seconds (_stream, u).

    The chain of window starts of a stream is sequential, so it is composed level by level. Each stretch of the
    time line (of fixed length, hence a bounded number of distinct seconds) reports for each second at
    which the chain may enter it where the chain leaves it. Those hops are doubled: a round joins them with
    themselves and reaches twice as many stretches from the first second of each stream. In the end each
    stretch marks its own starts from where it was entered. One task sees some stretches of some streams, bounded
    by the span of the time line and not by the posts.
    """
    stretch = length * max(64, _STRETCH_SECONDS // length)
    secs = cut(seconds.select("_stream", "u", F.floor(F.col("u") / stretch).alias("stretch")))
    rows, stretches = secs.agg(F.count(F.lit(1)), F.approx_count_distinct("stretch")).first()
    parts = max(1, rows // (_TASK_SECONDS * max(stretches, 1)))
    part = F.pmod(F.xxhash64("_stream"), F.lit(parts)).alias("part")
    by_time = Window.partitionBy("_stream").orderBy("stretch")
    order = secs.groupBy("_stream", "stretch").agg(F.min("u").alias("first_u")).select(
        "_stream", "stretch", "first_u",
        F.lag("stretch", 1).over(by_time).alias("before"),
        F.lag("stretch", 2).over(by_time).alias("before2"),
    )

    # a stretch also sees where the chain can enter the next one: its first window length and the
    # first second after that; if it has none, the first second of the stretch after the next
    start = F.col("stretch") * stretch
    late = secs.filter(F.col("u") >= start + length).groupBy("_stream", "stretch").agg(F.min("u").alias("u"))
    heads = secs.filter(F.col("u") < start + length).unionByName(late)
    ahead = (heads.join(order, ["_stream", "stretch"]).filter("before is not null")
             .select("_stream", F.col("before").alias("stretch"), "u")
             .unionByName(order.filter("before2 is not null")
                          .select("_stream", F.col("before2").alias("stretch"), F.col("first_u").alias("u"))))
    seen = secs.withColumn("own", F.lit(True)).unionByName(ahead.withColumn("own", F.lit(False))).withColumn("part", part)
    hops = cut(seen.groupBy("stretch", "part").applyInPandas(
        lambda pdf: _leave(pdf, length, stretch), "_stream string, u long, exit_u long").filter("exit_u is not null"))
    first = secs.groupBy("_stream").agg(F.min("u").alias("u"))
    entered = _reached(first, hops).select("_stream", F.floor(F.col("u") / stretch).alias("stretch"), F.col("u").alias("entry"))
    return secs.join(entered, ["_stream", "stretch"]).withColumn("part", part).groupBy("stretch", "part").applyInPandas(
        lambda pdf: _mark(pdf, length), "_stream string, window_id long")


def _reached(first: DataFrame, hops: DataFrame) -> DataFrame:
    """All (_stream, u) that hops lead to from `first`: each round, hops reach twice as far."""
    reached = first
    while not hops.isEmpty():
        reached = cut(reached.unionByName(
            reached.join(hops, ["_stream", "u"]).select("_stream", F.col("exit_u").alias("u"))))
        onward = hops.select("_stream", F.col("u").alias("exit_u"), F.col("exit_u").alias("then"))
        hops = cut(hops.join(onward, ["_stream", "exit_u"]).select("_stream", "u", F.col("then").alias("exit_u")))
    return reached


def _ordered(pdf: pd.DataFrame, length: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by stream and second, the number of each row's stream, and the row a window length on (else -1)."""
    pdf = pdf.sort_values(["_stream", "u"], ignore_index=True)
    stream = pd.factorize(pdf["_stream"])[0]
    u = pdf["u"].to_numpy()
    # streams one after the other on a line, further apart than a window
    line = stream * (u.max() - u.min() + length + 1) + (u - u.min())
    onward = np.searchsorted(line, line + length)
    there = onward < len(u)
    there[there] = stream[onward[there]] == stream[there]
    return pdf, stream, np.where(there, onward, -1)


def _leave(pdf: pd.DataFrame, length: int, stretch: int) -> pd.DataFrame:
    """Where the chain leaves the stretch, from each second at which it may enter."""
    pdf, stream, onward = _ordered(pdf, length)
    u, own = pdf["u"].to_numpy(), pdf["own"].to_numpy(dtype=bool)
    place = np.arange(len(u))
    to = np.where(own & (onward >= 0), onward, place)
    while not (to[to] == to).all():
        to = to[to]
    begin = int(pdf["stretch"].iloc[0]) * stretch
    early = own & (u < begin + length)
    follows_late = np.zeros(len(u), bool)
    follows_late[1:] = (stream[1:] == stream[:-1]) & (u[:-1] >= begin + length)
    keep = early | (own & ~follows_late)
    # a chain that ends among the stretch's own seconds leaves it nowhere
    left = pd.Series(u[to], dtype="Int64").mask(own[to])
    return pd.DataFrame({"_stream": pdf["_stream"], "u": u, "exit_u": left})[keep]


def _mark(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """The starts of each stream, followed from its entry."""
    pdf, stream, onward = _ordered(pdf, length)
    at = np.flatnonzero(pdf["u"].to_numpy() == pdf["entry"].to_numpy())
    marked = []
    while len(at):
        marked.append(at)
        at = onward[at]
        at = at[at >= 0]
    rows = pdf.iloc[np.concatenate(marked)]
    return pd.DataFrame({"_stream": rows["_stream"], "window_id": rows["u"]})


def window_sequence(windowed: DataFrame, history_windows: int = 4, by: str | None = None) -> DataFrame:
    """One row per window (and stream): its number, its history block and its place in the block.

    The frame sees one row per window, not per post.
    """
    keys = [by] if by else []
    starts = windowed.select(*keys, "window_id").distinct()
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("window_id"))
    return starts.select(
        *keys, "window_id", seq.alias("window_seq"),
        F.floor((seq - 1) / history_windows).alias("block"),
        (F.pmod(seq - 1, F.lit(history_windows)) + 1).alias("place"),
    )


def with_trigger(windowed: DataFrame, open_anchor: int | None = None, by: str | None = None) -> DataFrame:
    """Add `trigger`: whether the post closes the window before, i.e. is the first post of its window.

    The earliest window of all (of each stream) has no such post, nor has the rest of a window already open.
    """
    keyed = windowed.withColumn("_stream", _stream(by))
    firsts = keyed.groupBy("_stream", "window_id").agg(F.min(F.struct("ts", "post_id")).alias("_first"))
    if open_anchor is None:
        earliest = firsts.groupBy("_stream").agg(F.min("window_id").alias("_earliest"))
    else:
        earliest = windowed.sparkSession.range(1).select(F.lit("").alias("_stream"), F.lit(open_anchor).alias("_earliest"))
    triggers = (firsts.join(earliest if by else F.broadcast(earliest), "_stream").filter(F.col("window_id") > F.col("_earliest"))
                .select("_stream", "window_id", F.col("_first.post_id").alias("post_id"), F.lit(True).alias("trigger")))
    if not by:
        triggers = cut(triggers)  # one row per window: written, they are seen to be few, and the posts stay where they are
    return (keyed.join(triggers, ["_stream", "window_id", "post_id"], "left")
            .select(*windowed.columns, F.coalesce("trigger", F.lit(False)).alias("trigger")))


def drop_triggers(windowed: DataFrame, by: str | None = None) -> DataFrame:
    """Drop the posts that close windows."""
    return with_trigger(windowed, by=by).filter(~F.col("trigger")).drop("trigger")


def drop_open_tail(windowed: DataFrame, by: str | None = None) -> DataFrame:
    """Drop the last window (of each stream), which no later post has closed."""
    keyed = windowed.withColumn("_stream", _stream(by))
    last = keyed.groupBy("_stream").agg(F.max("window_id").alias("_last"))
    return (keyed.join(last if by else F.broadcast(last), "_stream")  # without streams, one row
            .filter(F.col("window_id") < F.col("_last")).select(*windowed.columns))
