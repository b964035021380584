"""From cluster headlines to the topics of a window.

A window has at most `max_headlines` headlines here, so its rows fit in any task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.functions import text as tx
from burstline.operators.distance import DIGITS, profile_matrix
from burstline.operators.linkage import link
from burstline.operators.windows import window_label, window_start
from burstline.params import TopicParams


def _headline_words() -> Column:
    return F.transform(tx.headline_tokens(F.col("bag")), lambda t: F.lower(F.trim(t)))


def headline_distances(headlines: DataFrame) -> DataFrame:
    """Cosine distances of the word sets of the headlines of a window, for each rank x < rank y."""
    words = headlines.select("window_id", "rank", F.array_distinct(_headline_words()).alias("words"))
    x = words.select("window_id", F.col("rank").alias("x"), F.col("words").alias("xw"))
    y = words.select("window_id", F.col("rank").alias("y"), F.col("words").alias("yw"))
    common = F.size(F.array_intersect("xw", "yw"))
    norms = F.sqrt(F.size("xw").cast("double") * F.size("yw"))
    return (x.join(y, "window_id").filter("x < y")
            .select("window_id", "x", "y",
                    (1 - F.when(norms > 0, common / norms).otherwise(F.lit(0.0))).alias("d")))


def _group_headlines(pdf: pd.DataFrame, cut_share: float) -> pd.DataFrame:
    pdf = pdf.sort_values("rank")
    vocab = {t: i for i, t in enumerate(sorted({t for words in pdf["words"] for t in words}))}
    held = np.zeros((len(pdf), max(len(vocab), 1)))
    for row, words in enumerate(pdf["words"]):
        held[row, [vocab[t] for t in words]] = 1
    norm = np.sqrt(held.sum(axis=1))
    norms = np.outer(norm, norm)
    d = 1 - np.divide(held @ held.T, norms, out=np.zeros_like(norms), where=norms > 0)
    np.fill_diagonal(d, 0.0)
    one = np.ones(len(pdf))
    labels = link(profile_matrix(d, one), one, cut_share * d.max())
    ranks = pdf["rank"].to_numpy()
    return pd.DataFrame({"window_id": pdf["window_id"], "rank": ranks, "topic": ranks[labels]})


def headline_topics(headlines: DataFrame, params: TopicParams) -> DataFrame:
    """Group like headlines: (window_id, rank, topic), a topic named after its best headline."""
    share = params.headline_cut_share
    return (headlines.select("window_id", "rank", _headline_words().alias("words"))
            .groupBy("window_id").applyInPandas(
                lambda pdf: _group_headlines(pdf, share), "window_id long, rank int, topic int"))


def topic_scores(headlines: DataFrame, groups: DataFrame, params: TopicParams) -> DataFrame:
    """Best cluster score per topic; the top topics of each window with their headlines in order."""
    shown = tx.display_text(F.col("text"))
    item = F.struct(
        "rank", "cluster_id", "post_id", "media_urls", "bag", shown.alias("shown"),
        F.array_join(tx.headline_tokens(F.col("bag")), " ").alias("words"))
    by_score = Window.partitionBy("window_id").orderBy(F.desc(F.round("score", DIGITS)), F.asc("first"))
    return (headlines.join(groups, ["window_id", "rank"])
            .groupBy("window_id", "topic")
            .agg(F.max("score").alias("score"), F.min("first").alias("first"),
                 F.sort_array(F.collect_list(item)).alias("items"))
            .withColumn("rank", F.row_number().over(by_score))
            .filter(F.col("rank") <= params.max_topics))


def topic_sizes(headlines: DataFrame, groups: DataFrame, params: TopicParams) -> DataFrame:
    """All topics of each window, also those beyond the listed ones: headlines and posts in it, score and rank."""
    by_score = Window.partitionBy("window_id").orderBy(F.desc(F.round("score", DIGITS)), F.asc("first"))
    return (headlines.join(groups, ["window_id", "rank"]).groupBy("window_id", "topic")
            .agg(F.count(F.lit(1)).alias("n_headlines"), F.sum("size").alias("n_posts"), F.max("score").alias("score"),
                 F.min("first").alias("first"))
            .withColumn("rank", F.row_number().over(by_score))
            .select("window_id", "topic", "n_headlines", "n_posts", "score", "rank",
                    (F.col("rank") <= params.max_topics).alias("listed")))


def media_fallback(ranked: DataFrame, pruned: DataFrame, pats: DataFrame, labels: DataFrame,
                   eligible: DataFrame) -> DataFrame:
    """For topics whose headline posts have no media: the first other post of their clusters that has,
    and whose text differs from the headline texts.

    One minimum per topic, combined before the shuffle; the members are never gathered.
    """
    bare = ranked.filter(F.size(F.flatten("items.media_urls")) == 0)
    clusters = bare.select(
        "window_id", "topic", F.col("items.post_id").alias("chosen"),
        F.transform("items", lambda i: F.trim(i["shown"])).alias("texts"), F.explode("items").alias("i")
    ).select("window_id", "topic", "chosen", "texts", F.col("i.rank").alias("order"), F.col("i.cluster_id").alias("cluster_id"))
    wanted = (clusters.join(labels, ["window_id", "cluster_id"])
              .join(pats.select("window_id", "pattern_id", "terms"), ["window_id", "pattern_id"])
              .select("window_id", "terms", "topic", "chosen", "texts", "order"))
    with_media = eligible.filter(F.size("media_urls") > 0).select("window_id", "post_id", "text", "media_urls")
    return (pruned.join(wanted, ["window_id", "terms"])
            .join(with_media, ["window_id", "post_id"])
            .filter(~F.array_contains("chosen", F.col("post_id"))
                    & ~F.array_contains("texts", F.trim(tx.display_text(F.col("text")))))
            .groupBy("window_id", "topic")
            .agg(F.min(F.struct("order", "ts", "post_id", "media_urls")).alias("extra")))


def topic_rows(ranked: DataFrame, fallback: DataFrame) -> DataFrame:
    """The topic table: one row per topic, best first."""
    items = F.col("items")
    extra_post = F.when(F.col("extra").isNull(), F.array().cast("array<bigint>")).otherwise(
        F.array("extra.post_id"))
    extra_media = F.coalesce("extra.media_urls", F.array().cast("array<string>"))
    keywords = F.array_sort(F.array_distinct(F.transform(F.flatten(items["bag"]), F.lower)))
    return ranked.join(fallback, ["window_id", "topic"], "left").select(
        "window_id", window_start(F.col("window_id")).alias("window_start"),
        window_label(F.col("window_id")).alias("window_label"), "rank", "score",
        items[0]["shown"].alias("headline"),
        F.array_join(F.transform(items["words"], lambda w: F.concat(w, F.lit("//"))), "").alias("label"),
        keywords.alias("keywords"),
        F.concat(items["post_id"], extra_post).alias("post_ids"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(items["media_urls"]), extra_media))).alias("media_urls"),
    )
