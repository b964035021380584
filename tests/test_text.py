import pytest
from pyspark.sql import functions as F

from burstline.functions import text as tx
from burstline.operators import filters as fl


def one(spark, text, column, **extra):
    cols = {"text": text, **extra}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(
        f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("text,words", [
    ("see http://t.co/x1 www.a.b/c pic.twitter.com/zz now ok then fine", "see ok fine"),
    ("hi @someone, #tagged words here", "hi words"),
    ("U.K. end.Next stops", "UK endNext stops"),
    ("it's \"quoted\" ‘curly’ “double” it’s", "quoted curly double"),
    ("back\\slash tilde~ tick` small˜tilde", "back\\slash tilde~ tick` small tilde"),
    ("R&D Q&A &amp; &lt", "R&D Q&A"),
    ("a1b22c covid19 4th 100%", "covid"),
    ("café naïve über €5 £6 «guillemet fire🔥works ❤love", "café naïve über guillemet fire works love"),
    ("The WENT were RT lol Rather rather U.S.", "WENT"),
    ("wentwere went", "went"),
    ("one\ttwo\nthree\r\nfour", "one two three four"),
    ("", ""), ("   ", ""),
])
def test_words(spark, text, words):
    got = one(spark, text, tx.content_words(tx.normalized_text(F.col("text"))))
    assert " ".join(got) == words


def test_display_text_drops_links_and_line_breaks(spark):
    assert one(spark, "a http://x.y/z b\nc\td www.q.r", tx.display_text(F.col("text"))) == "a  b c d "


def test_bag_order_and_stop_tags(spark):
    bag = tx.token_bag(F.col("u"), F.col("h"), F.split("text", " "))
    got = one(spark, "Big News", bag, u=["Bob", "ann", "Bob"], h=["Fun", "RT", "retweet", "fun", "Fun"])
    assert got == ["@bob", "@ann", "#fun", "#fun", "Big", "News"]


@pytest.mark.parametrize("tokens,grams", [
    ([], []), (["a"], []), (["a", "b"], ["a b"]), (["a", "b", "c"], ["a b", "b c", "a b c"]),
    (["a", "a", "a", "a"], ["a a", "a a a"]),
])
def test_ngrams(spark, tokens, grams):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(tx.ngrams(F.col("t")).alias("g")).first().g == grams


def test_token_views(spark):
    df = spark.createDataFrame([(["@bob", "#Tag", " Word", "x@y"],)], "bag array<string>")
    row = df.select(tx.feature_tokens(F.col("bag")).alias("f"), tx.headline_tokens(F.col("bag")).alias("h")).first()
    assert row.f == ["#tag", "word"] and row.h == [" Word"]


def test_spam_and_eligibility(spark):
    four = "Storm hits northern coast"
    rows = [
        (1, four, [], []), (2, "Storm hits coast", [], []), (3, four.upper(), [], []),
        (4, four, ["a", "b"], ["c", "d"]), (5, four, ["a", "b", "c"], []), (6, four, [], ["a", "b", "c"]),
        (7, four + " please follow me", [], []), (8, four + " Please Follow Me", [], []),
        (9, "storm " * 4, ["a", "a", "a"], []), (10, "", [], []),
    ]
    posts = spark.createDataFrame(rows, "post_id long, text string, users array<string>, hashtags array<string>")
    clean = fl.spam_filter(posts)
    assert {r.post_id for r in clean.collect()} == {1, 2, 3, 4, 5, 6, 8, 9, 10}
    kept = fl.eligible_posts(fl.with_tokens(clean))
    assert {r.post_id for r in kept.collect()} == {1, 4, 8}
