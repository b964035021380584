"""Topic rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _listed(name: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), ", ").alias(name)


def topic_lines(topics: DataFrame) -> DataFrame:
    """The five text columns: window start, headline, keywords, post ids, media links."""
    return topics.select("window_label", "headline", _listed("keywords"), _listed("post_ids"),
                         _listed("media_urls"))


def write_topics_tsv(topics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text, sorted by window and rank across the part files."""
    ordered = topics.repartitionByRange("window_id", "rank").sortWithinPartitions("window_id", "rank")
    (topic_lines(ordered).write.mode(mode).option("sep", "\t").option("quote", "\u0000")
     .option("escape", "\u0000").option("emptyValue", "").csv(path))


def write_topics(topics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    topics.write.mode(mode).parquet(path)
