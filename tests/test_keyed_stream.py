import numpy as np
import pytest
from pyspark.sql import functions as F

from burstline.operators import windows as wn
from burstline.streaming.windows import anchored_stream, rocksdb_state

START = 1_700_000_000
SCHEMA = "user string, post_id long, second long, tags array<string>"
COLUMNS = ["user", "post_id", "tags", "window_id", "window_seq", "block", "place", "trigger"]


@pytest.fixture(scope="module")
def rows():
    """Two streams whose posts alternate, one without a key and one of a single post."""
    rng = np.random.default_rng(3)
    out = []
    for user, n, gap in [("a", 260, 40), ("b", 180, 70), (None, 60, 300), ("once", 1, 1)]:
        seconds = START + rng.integers(0, 300) + np.cumsum(rng.integers(0, gap, n))
        out += [(user, int(s)) for s in seconds]
    return [(u, i, s, ["x"] if i % 3 else []) for i, (u, s) in enumerate(sorted(out, key=lambda r: r[1]))]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("second")).drop("second")


def batch(posts):
    windowed = wn.with_trigger(wn.anchored_windows(posts, 2, by="user"), by="user")
    sequence = wn.window_sequence(windowed, by="user")
    return windowed.alias("w").join(sequence.alias("s"), (F.col("w.window_id") == F.col("s.window_id"))
                                    & F.col("w.user").eqNullSafe(F.col("s.user"))).select(
        "w.*", "s.window_seq", "s.block", "s.place")


def listed(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


def run(spark, source, out, check):
    posts = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    with rocksdb_state(spark):
        query = (anchored_stream(posts, 2, "user").writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None


def test_streams_equal_batch_across_a_restart(spark, rows, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    # batches end in the middle of windows, and rows of a batch come unsorted
    parts = [rows[:150], rows[150:330], rows[330:]]
    for part in parts[:2]:
        frame(spark, part[::-1]).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, check)
    frame(spark, parts[2]).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, check)  # goes on from the state of the first run
    got = spark.read.parquet(out)
    want = batch(frame(spark, rows))
    assert listed(got) == listed(want)
    assert got.agg(F.max("block")).first()[0] > 2 and got.where("user IS NULL").count() == 60


def test_late_posts_join_the_open_window(spark, rows, tmp_path):
    late = [("a", 9000, START - 50, []), ("b", 9001, START + 1, [])]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    half = rows[:200]
    for part in (half, late):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, check)
    got = spark.read.parquet(out)
    open_windows = {r.user: r.w for r in got.where("post_id < 9000").groupBy("user").agg(F.max("window_id").alias("w")).collect()}
    found = {r.user: (r.window_id, r.trigger) for r in got.where("post_id >= 9000").collect()}
    assert found == {"a": (open_windows["a"], False), "b": (open_windows["b"], False)}

