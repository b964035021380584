"""Query op5: fingerprints of all documents, of their edited texts, and likeness to the next document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstline.llm.sketches import compare_with_next


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
