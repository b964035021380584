"""Posts derived from plain tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the first document arrives at this second, the others a minute apart, their lines a second apart
FIRST_SECOND = 1_704_067_200
DOCUMENT_SECONDS = 60
# line numbers stay below this
LINES_PER_DOCUMENT = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input has fewer splits than cores, else leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per line of each document, in all languages, with `lang`.

    Words after @ and # in a line are its mentions and tags; the url of the page with the number of
    the document is the media link of its lines.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    media = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    lines = docs.join(media, "doc_id", "left").select(
        "doc_id", "lang", "url", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.select(
        F.when(F.col("line_no") < LINES_PER_DOCUMENT, F.col("doc_id") * LINES_PER_DOCUMENT + F.col("line_no"))
        .otherwise(F.raise_error(F.lit("a document has too many lines for its post ids"))).alias("post_id"),
        F.timestamp_seconds(FIRST_SECOND + F.col("doc_id") * DOCUMENT_SECONDS + F.col("line_no")).alias("ts"),
        "text", "lang",
        F.regexp_extract_all("text", F.lit(r"@(\w+)"), 1).alias("users"),
        F.regexp_extract_all("text", F.lit(r"#(\w+)"), 1).alias("hashtags"),
        F.when(F.col("url").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("url")).alias("media_urls"),
    )


def item_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of phrases: the second to fourth word of each benchmark item, as they stand."""
    words = F.split(F.regexp_replace("text", r"[ \n]+", " "), " ")
    return (table(spark, sf_dir, "benchmark").filter(F.size(words) >= 4)
            .select(F.array_join(F.slice(words, 2, 3), " ").alias("phrase")).distinct())


def short_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of stop words: the words of one to four letters in the benchmark items, in lower case."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w"))
    return words.filter((F.length("w") > 0) & (F.length("w") < 5)).select(F.lower("w").alias("word")).distinct()


def capital_words(spark: SparkSession, sf_dir: str, boost: float = 2.5) -> DataFrame:
    """A lexicon of names: words that the benchmark table writes with a capital."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w"))
    return (words.filter(F.col("w").rlike("^[A-Z]") & (F.length("w") > 1))
            .select(F.lower("w").alias("word")).distinct().withColumn("boost", F.lit(boost)))
