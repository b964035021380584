"""Topics of a stream of extracted posts, window by window as they close.

Each micro-batch stages its posts, and runs the batch operators over the windows that it closes. All
state beyond the ids already seen lies in tables below `out_dir`, one folder per micro-batch. A micro-batch only reads
folders of earlier ones: run again after a failure, it overwrites its own folders with the same rows. It reads those that
the state before it names, and no others, so its work does not grow with the age of the stream.

    state     what is open after the batch (one row), and which folders that lies in
    posts     staged posts with their window; kept until their windows have closed
    windows   closed windows with number, history block and place in it; kept until their block is full
    term_df   posts per term of closed windows, for the history of later ones; kept as long
    topics    the topic rows
    late      posts that came too late for their window

Ids already seen are state of the query (`dropDuplicatesWithinWatermark`), in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from burstline.functions.words import SPAM_PHRASES, STOP_WORDS
from burstline.lineage import cut, delete_folder, written_tables_freed
from burstline.operators import features as ft
from burstline.operators import filters as fl
from burstline.operators import weights as wt
from burstline.operators import windows as wn
from burstline.params import TopicParams
from burstline.plans.topics import Corpus, TopicTables
from burstline.sources.posts import first_by_post_id

_STATE = ("open_anchor long, newest long, newest_ms long, horizon long, windows_done long, "
          "posts array<struct<batch: long, last: long>>, history array<struct<batch: long, last: long>>")
_WINDOWS = "window_id long, window_seq int, block long, place int"
_TERM_DF = "window_id long, term string, df long, block long"
# column that marks the ids that pass as new
_NEW = "_new_id"


@dataclass(frozen=True)
class TopicStream:
    """Settings of a topic stream.

    With `anchored` a window closes when a post at or after its end arrives, and that post is in no
    window; older posts join the open window. Otherwise windows are aligned and close once the
    newest post is `delay_minutes` past their end; posts of closed windows are dropped.

    As in batch, of posts with one id the first counts, before spam is looked at and windows are made: a
    later post with an id that came in within `seen_minutes` of event time is dropped.

    Posts that come too late end up in the table `late`: those of windows already closed, and, with `dedupe`, those more
    than `seen_minutes` older than the newest post of earlier batches, of which nobody can tell any more whether
    their id came in before.
    """

    out_dir: str
    params: TopicParams = field(default_factory=TopicParams)
    anchored: bool = False
    delay_minutes: float = 0.0
    lexicon: DataFrame | None = None
    stop_words: Sequence[str] = tuple(STOP_WORDS)
    spam_phrases: Sequence[str] = tuple(SPAM_PHRASES)
    dedupe: bool = True
    seen_minutes: float = 24 * 60

    def start(self, posts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = (self.with_new_ids(posts).writeStream.foreachBatch(self.process)
                  .option("checkpointLocation", checkpoint))
        return (writer.trigger(**trigger) if trigger else writer).start()

    def with_new_ids(self, posts: DataFrame) -> DataFrame:
        """The posts, and once more, marked, one bare row per id that has not come in before."""
        if not self.dedupe:
            return posts
        new = (posts.select("ts", "post_id").withWatermark("ts", f"{round(self.seen_minutes * 60)} seconds")
               .dropDuplicatesWithinWatermark(["post_id"]))
        return posts.withColumn(_NEW, F.lit(False)).unionByName(new.withColumn(_NEW, F.lit(True)), allowMissingColumns=True)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of `with_new_ids`."""
        spark = batch.sparkSession
        with written_tables_freed(spark):
            self._process(spark, cut(batch), batch_id)  # the query's own state is only worked on once
        self._drop_closed(spark, batch_id)

    def _process(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        before = self._state(spark, batch_id - 1)
        newest_ms = _latest(batch.agg(F.unix_millis(F.max("ts"))).first()[0], before["newest_ms"])
        fresh, too_old = self._split(batch, before) if self.dedupe else (batch, None)
        staged, late = self._stage(fl.spam_filter(fresh, self.spam_phrases), before)
        staged = cut(staged)
        staged.write.mode("overwrite").partitionBy("window_id").parquet(self._folder("posts", batch_id))
        lost = [x for x in (late, too_old) if x is not None]
        if lost:
            rows = lost[0] if len(lost) == 1 else lost[0].unionByName(lost[1])
            rows.write.mode("overwrite").parquet(self._folder("late", batch_id))

        length = wn.window_length(self.params.window_minutes)
        newest, last = staged.agg(F.max(wn.epoch_second(F.col("ts"))), F.max("window_id")).first()
        newest, anchor = _latest(newest, before["newest"]), _latest(last, before["open_anchor"])
        if newest is None:
            horizon = None
        elif self.anchored:
            # everything before the window now open is closed
            horizon = anchor
        else:
            horizon = newest - int(self.delay_minutes * 60) - length + 1
        horizon = _latest(horizon, before["horizon"])

        held = [*before["posts"], *([(batch_id, last)] if last is not None else [])]
        done, history = before["windows_done"], before["history"]
        if horizon is not None and held:
            own = self._read(spark, "posts", staged.schema, [b for b, _ in held])
            closed = own.filter(F.col("window_id") < horizon)
            if before["horizon"] is not None:
                closed = closed.filter(F.col("window_id") >= before["horizon"])
            done, history = self._emit(closed, batch_id, done, history)
        held = [(b, w) for b, w in held if horizon is None or w >= horizon]
        # a folder of the history is read until the block of its last window is full
        history = [(b, block) for b, block in history if block >= done // self.params.history_windows]
        spark.createDataFrame([(anchor, newest, newest_ms, horizon, done, held, history)], _STATE).coalesce(1).write.mode(
            "overwrite").parquet(self._folder("state", batch_id))

    def _split(self, batch: DataFrame, before: dict) -> tuple[DataFrame, DataFrame]:
        """The earliest post of each new id, and posts too old to know whether their id is new."""
        posts = batch.filter(~F.col(_NEW)).drop(_NEW)
        new = batch.filter(_NEW).select("post_id")
        fresh = cut(first_by_post_id(posts).join(new, "post_id", "left_semi").select(*posts.columns))
        limit = (before["newest_ms"] or 0) - round(self.seen_minutes * 60) * 1000
        old = posts.filter(F.unix_millis("ts") <= limit) if before["newest_ms"] is not None else posts.limit(0)
        return fresh, old.join(new, "post_id", "left_anti").select(*posts.columns)

    def _stage(self, clean: DataFrame, before: dict) -> tuple[DataFrame, DataFrame | None]:
        """Posts with their window, and posts of windows that have closed."""
        if self.anchored:
            opened = before["open_anchor"]
            windowed = wn.anchored_windows(cut(clean), self.params.window_minutes, opened)
            return wn.with_trigger(windowed, opened), None
        windowed = wn.aligned_windows(clean, self.params.window_minutes).withColumn("trigger", F.lit(False))
        if before["horizon"] is None:
            return windowed, None
        is_open = F.col("window_id") >= before["horizon"]
        return windowed.filter(is_open), windowed.filter(~is_open).select(*clean.columns)

    def _emit(self, closed: DataFrame, batch_id: int, done: int, history: list) -> tuple[int, list]:
        """Write the topics of the closed windows; the number of windows so far, and the folders of the history."""
        spark = closed.sparkSession
        size = self.params.history_windows
        sequence = wn.window_sequence(closed, size).select(
            "window_id", (F.col("window_seq") + done).cast("int").alias("window_seq"))
        sequence = cut(sequence.select(
            "window_id", "window_seq", F.floor((F.col("window_seq") - 1) / size).alias("block"),
            (F.pmod(F.col("window_seq") - 1, F.lit(size)) + 1).cast("int").alias("place")))
        last, last_block = sequence.agg(F.max("window_seq"), F.max("block")).first()
        if last is None:
            return done, history
        corpus = Corpus(closed.filter(~F.col("trigger")), sequence, self.params, self.stop_words)
        df = cut(ft.term_df(corpus.patterns, corpus.vocab))

        block = F.col("block") == done // size
        batches = [b for b, _ in history]
        past = self._read(spark, "term_df", _TERM_DF, batches).filter(block)
        past_windows = self._read(spark, "windows", _WINDOWS, batches).filter(block)
        mean = wt.history_mean(df.unionByName(past.select(*df.columns)), sequence.unionByName(past_windows))
        now = mean.join(sequence.select("window_id"), "window_id", "left_semi")
        weights = wt.boost_terms(wt.burst_weight(now), self.lexicon)
        found = TopicTables(corpus, weights, self.params).topics

        df.join(sequence.select("window_id", "block"), "window_id").write.mode("overwrite").parquet(
            self._folder("term_df", batch_id))
        sequence.write.mode("overwrite").parquet(self._folder("windows", batch_id))
        found.write.mode("overwrite").parquet(self._folder("topics", batch_id))
        return last, [*history, (batch_id, last_block)]

    def _drop_closed(self, spark: SparkSession, batch_id: int) -> None:
        """Delete folders that neither this batch, should it run again, nor a later one reads."""
        older, before = self._state(spark, batch_id - 2), self._state(spark, batch_id - 1)
        for key, names in (("posts", ["posts"]), ("history", ["windows", "term_df"])):
            for b in {b for b, _ in older[key]} - {b for b, _ in before[key]}:
                for name in names:
                    delete_folder(spark, self._folder(name, b))
        if batch_id > 2:
            delete_folder(spark, self._folder("state", batch_id - 3))

    def topics(self, spark: SparkSession) -> DataFrame:
        """All topics written so far."""
        return spark.read.parquet(f"{self.out_dir}/topics")

    def late(self, spark: SparkSession) -> DataFrame:
        """All posts that came too late so far."""
        return spark.read.parquet(f"{self.out_dir}/late")

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.out_dir}/{name}/batch={batch_id}"

    def _read(self, spark: SparkSession, name: str, schema, batches: list[int]) -> DataFrame:
        """The folders of these batches, and of no others."""
        if not batches:
            return spark.createDataFrame([], schema)
        names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()
        return spark.read.schema(schema).option("basePath", f"{self.out_dir}/{name}").parquet(
            *[self._folder(name, b) for b in batches]).select(*names)

    def _state(self, spark: SparkSession, batch_id: int) -> dict:
        try:
            state = spark.read.schema(_STATE).parquet(self._folder("state", batch_id)).first().asDict()
        except AnalysisException:  # the first batch
            return {"open_anchor": None, "newest": None, "newest_ms": None, "horizon": None, "windows_done": 0,
                    "posts": [], "history": []}
        return state | {k: [tuple(r) for r in state[k]] for k in ("posts", "history")}


def _latest(*seen: int | None) -> int | None:
    return max((x for x in seen if x is not None), default=None)
