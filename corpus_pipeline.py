"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

`STAGES` names them in order; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return rows of `documents` with their columns; the last returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.exact_dedup import drop_exact_duplicates
from burstline.llm.mixing import MixParams, keep_mixed
from burstline.llm.ngram_join import JoinParams, one_of_each_group
from burstline.llm.op1 import TOKENIZER
from burstline.llm.op9 import domain_of
from burstline.llm.packing import pack
from burstline.llm.quality import keep_good

# near duplicates: five words, four fifths of all shingles shared
NEAR = JoinParams(size=5, percent=80)
# nine tenths of the tokens, drawn from all domains, languages and sources alike as far as they reach
MIX = MixParams(share_percent=90, max_epochs=1, seed=7)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), host=F.col("source"),
                     path=F.concat_ws("/", "source", "lang"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    return one_of_each_group(docs, params=NEAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought nearer to equal weights; documents are taken whole."""
    return keep_mixed(docs, domain=domain_of(F.col("source")), language=F.col("lang"), source=F.col("source"), params=MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold all that is left."""
    return pack(docs, TOKENIZER)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]
# hashes, a fitted model and a tokenizer are beyond SQL: the tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
