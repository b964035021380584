import datetime as dt

import pytest

from burstline import TopicParams
from burstline.operators import features as ft
from burstline.plans.topics import Corpus

START = dt.datetime(2024, 5, 1, 10, 0)


def eligible(spark):
    """Two windows and posts without one: each post has many words of its own, some share a run of words."""
    rows = []
    for i in range(400):
        own = [f"p{i}w{k}" for k in range(20)]
        shared = [f"s{i % 40}w{k}" for k in range(6)] if i % 4 == 0 else []
        rows.append(([0, 900, None][i % 3], i // 2 if i % 8 == 0 else None if i % 50 == 0 else i, START, own + shared))
    return spark.createDataFrame(rows + rows[:5], "window_id long, post_id long, ts timestamp, bag array<string>")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("most_blocks", [8192, 0])
def test_frequent_terms_lose_no_vocabulary(spark, monkeypatch, most_blocks):
    if not most_blocks:  # a filter of one short block, full of bits: more gets through, the result is the same
        monkeypatch.setattr(ft, "_MOST_BLOCKS", 1)
        monkeypatch.setattr(ft, "_BLOCK_BITS", 128)
    posts = eligible(spark)
    terms = ft.post_terms(posts)
    for floor in (1, 2, 4):
        few = ft.frequent_terms(posts, floor)
        vocab = ft.vocabulary(terms, posts, floor, 0.01)
        assert vocab.count() > 0
        assert rows_of(ft.vocabulary(few, posts, floor, 0.01)) == rows_of(vocab)
        assert rows_of(ft.pruned_posts(few, vocab)) == rows_of(ft.pruned_posts(terms, vocab))


def test_rare_terms_do_not_reach_the_joins(spark):
    """What is counted by term and joined with the vocabulary is about what belongs to it, not every term of a post."""
    posts = eligible(spark)
    corpus = Corpus(None, None, TopicParams(min_df_floor=2))
    corpus.eligible = posts
    terms = ft.post_terms(posts)
    frequent = terms.groupBy("window_id", "term").count().filter("count > 1").agg({"count": "sum"}).first()[0]
    assert corpus._terms.count() < 1.1 * frequent < 0.2 * terms.count()
