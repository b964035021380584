import datetime as dt
import json

from burstline.plans.extract import extract
from burstline.sources import posts as ps
from burstline.sources.topics import write_topics_tsv


def raw(post_id, **over):
    post = {
        "lang": "en", "created_at": "Mon Feb 17 14:14:44 +0000 2014", "id": post_id, "text": "own text",
        "user": {"followers_count": 5, "friends_count": 7},
        "entities": {"hashtags": [{"text": "Tag"}], "user_mentions": [{"screen_name": "Bob"}],
                     "urls": [{"expanded_url": "http://e.x"}], "media": [{"media_url": "http://m.x"}]}}
    post.update(over)
    return json.dumps({k: v for k, v in post.items() if v is not None})


def test_extract(spark, tmp_path):
    bare = {"hashtags": [], "user_mentions": [], "urls": []}
    lines = [
        raw(1), raw(2, lang="fr"), raw(3, text=None), raw(4, entities=None), raw(5, entities=bare),
        raw(6, retweeted_status={"text": "inner text"}), raw(7, created_at="yesterday"),
        raw(8)[:60], "not json", raw(9, text="  "),
    ]
    (tmp_path / "raw.json").write_text("\n".join(lines))
    extract(spark, str(tmp_path / "raw.json"), str(tmp_path / "posts"))
    got = {r.post_id: r for r in ps.read_posts(spark, str(tmp_path / "posts")).collect()}
    assert set(got) == {1, 5, 6, 9}
    assert got[1].ts == dt.datetime(2014, 2, 17, 14, 14, 44)
    assert got[1][2:] == (1, "own text", ["Tag"], ["Bob"], ["http://e.x"], ["http://m.x"], 5, 7)
    assert got[5].media_urls == [] and got[6].text == "inner text"
    assert ps.read_posts(spark, str(tmp_path / "posts"), "2014-02-18").count() == 0
    assert ps.read_posts(spark, str(tmp_path / "posts"), "2014-02-17", "2014-02-17").count() == 4
    bad = ps.rejected_posts(ps.read_raw_posts(spark, str(tmp_path / "raw.json")).cache()).collect()
    assert len(bad) == 5
    assert {r.missing for r in bad if r.post_id in (3, 7)} == {"text", "ts"}
    assert "not json" in {r.line for r in bad}
    kept = ps.read_rejects(spark, str(tmp_path / "posts"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, bad))

    def folders():
        return {str(f.parent.relative_to(tmp_path)) for f in (tmp_path / "posts").rglob("*.parquet")}

    before = folders(), sorted(map(str, got.values()))
    assert any(f.startswith("posts/kind=post/") and f.endswith("/event_date=2014-02-17") for f in before[0])
    extract(spark, str(tmp_path / "raw.json"), str(tmp_path / "posts"))  # again: nothing doubles, nothing is lost
    again = ps.read_posts(spark, str(tmp_path / "posts")).collect()
    assert (folders(), sorted(map(str, again))) == before
    (tmp_path / "more.json").write_text(raw(20) + "\nbroken")
    extract(spark, str(tmp_path / "more.json"), str(tmp_path / "posts"))  # another input adds to the table
    assert {r.post_id for r in ps.read_posts(spark, str(tmp_path / "posts")).collect()} == {1, 5, 6, 9, 20}
    assert ps.read_rejects(spark, str(tmp_path / "posts")).count() == 6


def test_first_by_post_id(spark):
    rows = [(1, 20, "late"), (1, 10, "early"), (2, 5, "only")]
    df = spark.createDataFrame(rows, "post_id long, ts long, text string")
    assert {r.post_id: r.text for r in ps.first_by_post_id(df).collect()} == {1: "early", 2: "only"}


def test_topic_lines_on_disk(spark, tmp_path):
    rows = [(2, 1, "w2", 'say "hi"', ["c"], [5], []), (1, 2, "w1", "second", ["b"], [4], ["http://m"]),
            (1, 1, "w1", "first", ["a", "b"], [3, 9], [])]
    df = spark.createDataFrame(rows, "window_id long, rank int, window_label string, headline string, "
                                     "keywords array<string>, post_ids array<long>, media_urls array<string>")
    write_topics_tsv(df, str(tmp_path / "out"))
    text = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert text == ["w1\tfirst\ta, b\t3, 9\t", "w1\tsecond\tb\t4\thttp://m", 'w2\tsay "hi"\tc\t5\t']


def test_each_line_is_extracted_or_rejected(spark, tmp_path):
    def line(**more):
        return json.dumps({"lang": "en", "created_at": "Mon Feb 17 14:14:44 +0000 2014", "id": 1, "text": "hello",
                           "user": {"followers_count": 1, "friends_count": 2},
                           "entities": {"hashtags": [], "user_mentions": [], "urls": []}} | more)

    good = [line(id=1), line(id=2) + "  ", "  " + line(id=3)]
    lacking = line(id=4)[:-1].replace('"lang": "en", ', "") + "}"
    bad = [line(id=5) + "}", line(id=6) + " trailing", line(id=7) + "]", line(id=8) + "] {}", line(id=9) + ",{}", lacking,
           line(id=10, entities={"hashtags": [], "user_mentions": [], "urls": [], "media": "x"}),
           line(id=11, retweeted_status={}, text=None), "[1]", "x", line(id=12)[:-1]]
    other = [line(id=13, lang="de")]
    path = tmp_path / "raw.json"
    path.write_text("\n".join(["", *good, *bad, " ", *other]))
    for raw in (ps.read_raw_posts(spark, str(path)), ps.parse_raw_lines(spark.read.text(str(path)))):
        assert sorted(r.post_id for r in ps.extract_posts(raw).collect()) == [1, 2, 3]
        assert ps.rejected_posts(raw).count() == len(bad)
