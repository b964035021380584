"""Query op3: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstline.llm.html_text import extract_text


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
