"""Query op10: the quality of all documents; a source is a host, a language of a source is a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm.quality import classify


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
