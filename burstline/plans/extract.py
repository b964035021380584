"""Batch job: raw JSON posts to the extracted post table, with what could not be extracted."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from burstline.sources import posts as ps


def extract(spark: SparkSession, raw_path: str, out_path: str, lang: str = "en", mode: str = "overwrite",
            batch: str | None = None) -> None:
    """One narrow stage: scan, sort into posts and rejects, project, write both.

    `read_posts` and `read_rejects` read the two parts back. Each line of the language, or of none, is in one of them.
    A run over the same `raw_path`, or with the same name as `batch`, replaces what it wrote before; runs over
    other inputs add to the table.
    """
    name = batch or hashlib.sha256(raw_path.encode()).hexdigest()[:16]
    ps.write_sorted_lines(ps.sorted_lines(ps.read_raw_posts(spark, raw_path), lang), out_path, name, mode)
