"""Query op13: tokens of two public tokenizers aligned in all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm.token_alignment import TokenizerPair, align_and_judge

PAIR = TokenizerPair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return align_and_judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), PAIR, groups_sha256=digest)
