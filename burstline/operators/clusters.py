"""Sizes, scores and headlines of post clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.operators.distance import DIGITS
from burstline.operators.features import pattern_of_post, share_or_floor
from burstline.params import TopicParams


def post_clusters(pruned: DataFrame, pats: DataFrame, labels: DataFrame) -> DataFrame:
    """The cluster of every pruned post."""
    return (pattern_of_post(pruned, pats).join(labels, ["window_id", "pattern_id"])
            .select("window_id", "post_id", "ts", "cluster_id"))


def cluster_sizes(pats: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts per cluster, and its first post in order of arrival."""
    return (labels.join(pats.select("window_id", "pattern_id", "n_posts", "ts"), ["window_id", "pattern_id"])
            .groupBy("window_id", "cluster_id")
            .agg(F.sum("n_posts").alias("size"),
                 F.min(F.struct("ts", F.col("pattern_id").alias("post_id"))).alias("first")))


def scored_clusters(sizes: DataFrame, params: TopicParams) -> DataFrame:
    """The largest clusters of each window down to the size gate, `gated` marking those that pass it.

    The first cluster below the gate stays in the list unless `keep_undersized` is off.
    """
    by_size = Window.partitionBy("window_id").orderBy(F.desc("size"), F.asc("first"))
    totals = sizes.groupBy("window_id").agg(F.sum("size").alias("_posts"))
    gate = share_or_floor(F.col("_posts"), params.cluster_share, params.cluster_floor)
    ranked = (sizes.withColumn("_by_size", F.row_number().over(by_size))
              .filter(F.col("_by_size") <= params.max_clusters)
              .join(totals, "window_id").withColumn("gated", F.col("size") >= gate))
    one_above = F.coalesce(F.lag("gated").over(Window.partitionBy("window_id").orderBy("_by_size")), F.lit(True))
    kept = F.col("gated") | one_above if params.keep_undersized else F.col("gated")
    return (ranked.withColumn("_kept", kept).filter("_kept")
            .select("window_id", "cluster_id", "size", "first", "gated"))


def cluster_scores(pats: DataFrame, labels: DataFrame, weights: DataFrame, params: TopicParams) -> DataFrame:
    """Largest boosted weight among the terms of the cluster, over its size; the best per window."""
    listed = scored_clusters(cluster_sizes(pats, labels), params)
    terms = (listed.filter("gated").select("window_id", "cluster_id")
             .join(labels, ["window_id", "cluster_id"])
             .join(pats.select("window_id", "pattern_id", "terms"), ["window_id", "pattern_id"])
             .select("window_id", "cluster_id", F.explode("terms").alias("term")).distinct())
    best = (terms.join(weights.select("window_id", "term", "boosted"), ["window_id", "term"])
            .groupBy("window_id", "cluster_id").agg(F.max("boosted").alias("_best")))
    by_score = Window.partitionBy("window_id").orderBy(F.desc(F.round("score", DIGITS)), F.asc("first"))
    return (listed.join(best, ["window_id", "cluster_id"], "left")
            .withColumn("score", F.coalesce(F.col("_best") / F.col("size"), F.lit(0.0)))
            .withColumn("rank", F.row_number().over(by_score))
            .filter(F.col("rank") <= params.max_headlines)
            .select("window_id", "cluster_id", "size", "score", "rank", "first"))


def cluster_headlines(scores: DataFrame, eligible: DataFrame) -> DataFrame:
    """The scored clusters with the first post of each: its text, bag and media."""
    return (scores.select("window_id", "cluster_id", "size", "score", "rank", "first",
                          F.col("first.post_id").alias("post_id"))
            .join(eligible.select("window_id", "post_id", "text", "media_urls", "bag"),
                  ["window_id", "post_id"]))
