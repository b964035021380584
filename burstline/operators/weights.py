"""How sharply a term bursts in its window against the windows before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_mean(term_df: DataFrame, sequence: DataFrame) -> DataFrame:
    """Mean df of the term over the earlier windows of the block, windows without it counting 0.

    A term has at most one row per window of the block, so a window frame holds a few rows only.
    """
    earlier = (Window.partitionBy("block", "term").orderBy("place")
               .rowsBetween(Window.unboundedPreceding, -1))
    return (term_df.join(sequence, "window_id")
            .withColumn("avg_df", F.coalesce(
                F.try_divide(F.sum("df").over(earlier), F.col("place") - 1), F.lit(0.0)))
            .select("window_id", "window_seq", "term", "df", "avg_df"))


def burst_weight(history: DataFrame) -> DataFrame:
    return history.withColumn(
        "weight", (F.col("df") + 1) / (F.log(F.col("avg_df") + 1) + 1))


def boost_terms(weights: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Multiply the weight by the largest boost any word of the term has in `lexicon(word, boost)`."""
    if lexicon is None:
        return weights.withColumn("boosted", F.col("weight"))
    # look each distinct term up once, not once per window
    words = (weights.select("term").distinct()
             .select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("word")))
    boosts = words.join(lexicon, "word").groupBy("term").agg(F.max("boost").alias("boost"))
    return (weights.join(boosts, "term", "left")
            .withColumn("boosted", F.col("weight") * F.coalesce("boost", F.lit(1.0)))
            .select(*weights.columns, "boosted"))


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    """The k terms of each window with the largest boosted weight."""
    by_weight = Window.partitionBy("window_id").orderBy(F.desc("boosted"), F.desc("term"))
    return (weights.withColumn("rank", F.row_number().over(by_weight))
            .filter(F.col("rank") <= k))
