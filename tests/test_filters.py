import random

from pyspark.sql import functions as F

from burstline.functions.words import SPAM_PHRASES, STOP_WORDS
from burstline.operators import filters as fl

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel the of and is".split()
SCHEMA = "post_id long, text string, users array<string>, hashtags array<string>"


def posts(spark, seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))
        text = rng.choice([text, text.title(), text + "  double " + text, text.replace(" ", "\n", 1), text + " " + rng.choice(SPAM_PHRASES)])
        rows.append((i, text, rng.sample(["Ann", "bob"], rng.randrange(3)), rng.choices(["The", "Tag", "tag", "of"], k=rng.randrange(3))))
    rows += [(n, "", [], []), (n + 1, "ab", ["x"], ["the"]), (1, rows[1][1], [], [])]
    return spark.createDataFrame(rows, SCHEMA)


def listed(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_phrases_by_table_equal_the_list(spark):
    df = posts(spark)
    for phrases in ([*SPAM_PHRASES, "lpha bravo charl", "a b", "ab", "x", "delta", "echo  double", "no such phrase at all", "lf\nhot"],
                    ["o the o", "  "], ["zzz"], [""], []):
        table = spark.createDataFrame([(p,) for p in [*phrases, *phrases[:1], None]], "phrase string")
        want = listed(fl.spam_filter(df, phrases))
        assert listed(fl.spam_filter_by_table(df, table)) == want
    assert 0 < len(listed(fl.spam_filter(df, SPAM_PHRASES))) < df.count()


def test_stop_words_by_table_equal_the_list(spark):
    df = posts(spark, 2).withColumn("shown", F.lit("clash"))
    for stop in ([*STOP_WORDS, "delta"], []):
        table = spark.createDataFrame([(w,) for w in [*stop, *stop[:2], None]], "word string")
        got = fl.with_tokens_by_table(df, table)
        assert got.columns == fl.with_tokens(df, stop or [""]).columns
        assert listed(got) == listed(fl.with_tokens(df, stop or [""]))
