import pytest
from pyspark.sql import functions as F

from burstline import TopicParams
from burstline.functions.words import SPAM_PHRASES
from burstline.lineage import cut
from burstline.plans import topics as pt
from burstline.sources import posts as ps
from burstline.sources import tables as tb
from burstline.streaming.topics import TopicStream

PARAMS = TopicParams(window_minutes=25, min_df_floor=2, cluster_floor=2)


@pytest.fixture(scope="module")
def posts(spark, sf_dir):
    raw = ps.language_filter(tb.document_posts(spark, sf_dir)).withColumn("created_at", F.lit(""))
    once = raw.select(
        "ts", "created_at", "post_id", "text", "hashtags", "users",
        F.col("media_urls").alias("urls"), "media_urls",
        F.lit(1).cast("long").alias("n_followers"), F.lit(1).cast("long").alias("n_friends"))
    # ids that come again: in the same window, in a later one, and first as spam
    again = once.filter("post_id % 5 = 0").withColumn("ts", F.expr("ts + interval 70 minutes"))
    soon = once.filter("post_id % 7 = 0").withColumn("ts", F.expr("ts + interval 30 seconds"))
    spam = once.filter("post_id % 11 = 0").withColumn("ts", F.expr("ts - interval 20 seconds")).withColumn(
        "text", F.concat("text", F.lit(" " + SPAM_PHRASES[0])))
    return once.unionByName(again).unionByName(soon).unionByName(spam)


@pytest.mark.parametrize("anchored", [False, True])
def test_stream_equals_batch_over_closed_windows(spark, posts, tmp_path, anchored):
    source = tmp_path / "in"
    cuts = [0, 7000, 99999]
    first = tb.FIRST_SECOND
    # batches split in the middle of windows, in time order
    for lo, hi in zip(cuts, cuts[1:]):
        second = F.unix_timestamp("ts") - first
        (posts.filter((second >= lo) & (second < hi)).coalesce(1).write.mode("append").parquet(str(source)))
    stream = TopicStream(str(tmp_path / "out"), PARAMS, anchored=anchored)
    query = stream.start(ps.read_posts_stream(spark, str(source), max_files=1),
                         str(tmp_path / "check"), availableNow=True)
    query.awaitTermination(300)
    assert query.exception() is None
    batch = pt.detect_topics(posts, PARAMS, anchored=anchored, drop_tail=True).topics
    got = stream.topics(spark).drop("batch").toPandas().sort_values(["window_id", "rank"], ignore_index=True)
    want = batch.toPandas().sort_values(["window_id", "rank"], ignore_index=True)
    assert got.window_id.nunique() > 3
    assert got[list(want)].astype(str).equals(want.astype(str))


def fed(spark, posts, source, cuts):
    """Write posts as files in time order, cut at these seconds; each becomes a batch."""
    second = F.unix_timestamp("ts") - tb.FIRST_SECOND
    for lo, hi in zip(cuts, cuts[1:]):
        posts.filter((second >= lo) & (second < hi)).coalesce(1).write.mode("append").parquet(source)


def run(spark, stream, source, check):
    query = stream.start(ps.read_posts_stream(spark, source, max_files=1), check, availableNow=True)
    query.awaitTermination(600)
    assert query.exception() is None


def listed(topics, columns):
    return topics.select(*columns).toPandas().sort_values(["window_id", "rank"], ignore_index=True).astype(str)


def test_late_posts_and_repeated_ids(spark, posts, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    fed(spark, posts, source, [0, 7000, 99999])
    one = posts.limit(1)
    shown = dict(created_at=F.lit("late"))
    # an id that came in batches ago comes again, in time; and new ids whose time lies hours back
    again = posts.filter(F.unix_timestamp("ts") - tb.FIRST_SECOND < 3000).limit(5).withColumns(
        {**shown, "ts": F.timestamp_seconds(F.lit(tb.FIRST_SECOND + 99_999))})
    late = one.withColumns({**shown, "post_id": F.lit(-1).cast("long"), "ts": F.timestamp_seconds(F.lit(tb.FIRST_SECOND - 50_000))})
    behind = one.withColumns({**shown, "post_id": F.lit(-2).cast("long"), "ts": F.timestamp_seconds(F.lit(tb.FIRST_SECOND + 2000))})
    again.unionByName(late).unionByName(behind).coalesce(1).write.mode("append").parquet(source)
    # the last batch is empty of news but for what closes the windows before it
    closing = one.withColumns({"post_id": F.lit(-3).cast("long"), "ts": F.timestamp_seconds(F.lit(tb.FIRST_SECOND + 400_000))})
    closing.coalesce(1).write.mode("append").parquet(source)
    stream = TopicStream(out, PARAMS, seen_minutes=600)
    run(spark, stream, source, check)
    assert {r.post_id for r in stream.late(spark).collect()} == {-1, -2}
    arrived = posts.unionByName(again).unionByName(closing)
    batch = pt.detect_topics(arrived, PARAMS, drop_tail=True).topics
    assert listed(stream.topics(spark), batch.columns).equals(listed(batch, batch.columns))


def test_a_batch_reads_a_bounded_number_of_folders(spark, posts, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    few = cut(posts.filter("post_id % 4 = 0"))
    end = few.agg(F.max(F.unix_timestamp("ts"))).first()[0] - tb.FIRST_SECOND
    fed(spark, few, source, [*range(0, end, end // 5), end + 1])
    stream = TopicStream(out, PARAMS)
    run(spark, stream, source, check)
    batches = len(list((tmp_path / "out" / "topics").iterdir()))
    kept = {n: len(list((tmp_path / "out" / n).iterdir())) for n in ("posts", "windows", "term_df", "state")}
    assert batches > 3 and max(kept.values()) <= 3, kept
    batch = pt.detect_topics(few, PARAMS, drop_tail=True).topics
    assert listed(stream.topics(spark), batch.columns).equals(listed(batch, batch.columns))
