"""Query op4: a verdict on the url of every page.

The pages carry the number of their document in the path; its label marks the url for mining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm.url_rules import SiteRule, judge_urls, mine_rules

SITES = [
    SiteRule("com", "/", "allow"),
    SiteRule("example.com", "/en/", "block"),
    SiteRule("www.example.com", "/en/", "allow"),
    SiteRule("net", "/es/", "block"),
    SiteRule("net", "/fr/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    labelled = (pages.select("url", F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS bigint)").alias("doc_id"))
                .join(labels.select("doc_id", bad), "doc_id").select("url", "bad"))
    return judge_urls(pages, mine_rules(labelled), SITES)
