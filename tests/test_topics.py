import datetime as dt
import math

import pytest

from burstline import TopicParams
from burstline.plans import topics as pt

START = dt.datetime(2024, 5, 1, 10, 0, tzinfo=dt.timezone.utc)
STORM = "Alpha Bravo Charlie Delta Echo Foxtrot"
VOTE = "Kilo Lima Mike November Oscar Papa"
LINK = " http://t.co/abc"


def golden(spark):
    """Three anchored quarter-hours and the post that closes the third."""
    rows, number = [], iter(range(1, 1000))

    def add(second, text, media=()):
        rows.append((next(number), START + dt.timedelta(seconds=second), text, list(media)))

    add(0, STORM)                                # 1: first post of all, kept
    for i in range(11):                          # 2-12
        add(10 + i, STORM + (LINK if i == 3 else ""), ["http://same.text"] if i == 3 else [])
    add(30, STORM + "!", ["http://m.storm"])     # 13: other text, same terms, with media
    for i in range(11):                          # 14-24
        add(40 + i, VOTE, ["http://m.vote"] if i == 0 else [])
    add(60, "Unrelated words nobody repeats ever")
    add(70, "please follow me " + STORM)         # spam
    add(900, VOTE)                               # closes the first window, in none
    for i in range(10):
        add(910 + i, STORM)
    add(2500, VOTE)                              # closes the second
    add(2501, STORM)
    add(9000, VOTE)                              # closes the third, opens the tail
    return spark.createDataFrame(rows, "post_id long, ts timestamp, text string, media_urls array<string>").selectExpr(
        "*", "array() AS users", "array() AS hashtags").selectExpr(
        "post_id", "ts", "text", "media_urls", "cast(users AS array<string>) users",
        "cast(hashtags AS array<string>) hashtags")


@pytest.fixture(scope="module")
def run(spark):
    lexicon = spark.createDataFrame([("kilo", 2.5)], "word string, boost double")
    return pt.detect_topics(golden(spark), TopicParams(), anchored=True, lexicon=lexicon)


def test_golden_topics(run):
    rows = run.topics.orderBy("window_id", "rank").collect()
    assert [(r.window_label, r.rank) for r in rows] == [
        ("01-05-2024 10:00", 1), ("01-05-2024 10:00", 2), ("01-05-2024 10:15", 1)]
    vote, storm, again = rows
    assert vote.score == pytest.approx(12 * 2.5 / 11)
    assert vote.headline == VOTE and vote.label == VOTE + "//"
    assert vote.keywords == sorted(VOTE.lower().split())
    assert vote.post_ids == [14] and vote.media_urls == ["http://m.vote"]
    # no media on the headline post: the next post with media whose shown text differs. The one
    # with a link differs by a trailing blank only, so it does not count
    assert storm.score == pytest.approx(14 / 13)
    assert storm.post_ids == [1, 13] and storm.media_urls == ["http://m.storm"]
    # all posts of the second window are alike, and the terms were seen 13 times in the one before
    assert again.score == pytest.approx(11 / (math.log(14) + 1) / 10)
    assert again.media_urls == []


def test_golden_stats(run):
    got = {r.window_start.strftime("%H:%M"): r[1:5] for r in run.corpus.stats().collect()}
    assert got["10:00"] == (25, 25, 18, 24)
    assert got["10:15"] == (10, 10, 9, 10)


def test_size_gate_keeps_one_undersized_cluster(spark):
    params = TopicParams(cluster_floor=12)
    gated = pt.detect_topics(golden(spark), params, anchored=True).scores.orderBy("window_id", "rank").collect()
    assert [(r.size, r.score > 0) for r in gated] == [(13, True), (11, False), (10, False)]


def test_results_do_not_depend_on_partitioning(spark, run):
    lexicon = spark.createDataFrame([("kilo", 2.5)], "word string, boost double")
    other = pt.detect_topics(golden(spark).repartition(13, "text"), TopicParams(), anchored=True, lexicon=lexicon)
    assert sorted(map(str, run.topics.collect())) == sorted(map(str, other.topics.collect()))


def test_no_posts(spark):
    assert pt.detect_topics(golden(spark).filter("false"), TopicParams()).topics.count() == 0


def test_aligned_posts_are_read_once(spark, tmp_path):
    golden(spark).write.parquet(str(tmp_path / "posts"))
    corpus = pt.window_corpus(spark.read.parquet(str(tmp_path / "posts")), TopicParams(), dedupe=False)
    for table in (corpus.sequence, pt.term_weights(corpus), corpus.stats()):
        assert not any(str(tmp_path) in f for f in table.inputFiles())
    sizes = {r.window_label: r.n_posts for r in corpus.stats().selectExpr("date_format(window_start, 'HH:mm') window_label", "n_posts").collect()}
    assert sizes == {"10:00": 25, "10:15": 11, "10:30": 2, "12:30": 1}


def test_anchored_posts_are_read_once(spark, tmp_path):
    golden(spark).write.parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    corpus = pt.window_corpus(posts, TopicParams(), anchored=True, dedupe=False)
    for table in (corpus.windowed, corpus.sequence, corpus.stats()):
        assert not any(str(tmp_path) in f for f in table.inputFiles())
    assert "SortMergeJoin" not in corpus.windowed._jdf.queryExecution().executedPlan().toString()
