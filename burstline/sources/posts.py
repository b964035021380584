"""Raw JSON posts in, extracted posts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _items(field: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(field, T.StringType())]))


RAW_SCHEMA = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("user", T.StructType([
        T.StructField("followers_count", T.LongType()),
        T.StructField("friends_count", T.LongType()),
    ])),
    T.StructField("retweeted_status", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("entities", T.StructType([
        T.StructField("hashtags", _items("text")),
        T.StructField("user_mentions", _items("screen_name")),
        T.StructField("urls", _items("expanded_url")),
        T.StructField("media", _items("media_url")),
    ])),
])

_CORRUPT = "_corrupt_record"
# what becomes of a raw line
POST, REJECT = "post", "reject"
_READ_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])

POST_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("post_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("hashtags", T.ArrayType(T.StringType())),
    T.StructField("users", T.ArrayType(T.StringType())),
    T.StructField("urls", T.ArrayType(T.StringType())),
    T.StructField("media_urls", T.ArrayType(T.StringType())),
    T.StructField("n_followers", T.LongType()),
    T.StructField("n_friends", T.LongType()),
])

# The date text of a raw post, e.g. "Mon Feb 17 14:14:44 +0000 2014".
CREATED_AT_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the fixed schema; broken lines keep their text in `_corrupt_record`."""
    return parse_raw_lines(spark.read.text(path))


def read_raw_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_raw_lines(reader.text(path))


def parse_raw_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One raw post per line that is not blank. A line that is not one whole JSON object is broken."""
    line = F.col(column)
    parsed = F.from_json(line, _READ_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # the built-in parsers stop at the end of the first object: what follows it shows inside brackets
    whole = ((F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1)
             & (F.size(F.json_object_keys(F.concat(F.lit('{"line":'), line, F.lit("}")))) == 1)
             & F.startswith(F.ltrim(line), F.lit("{")))
    broken = F.when(~F.coalesce(whole, F.lit(False)), line)
    return (lines.filter(F.trim(line) != "").select(parsed.alias("r"), broken.alias("broken"))
            .select("r.*", "broken").withColumn(_CORRUPT, F.coalesce(F.col("broken"), F.col(_CORRUPT))).drop("broken"))


def language_filter(df: DataFrame, lang: str = "en") -> DataFrame:
    return df.filter(F.col("lang") == lang)


def parse_created_at(created_at: Column) -> Column:
    """Event time of the date text, null when it is malformed. The week day is skipped."""
    return F.try_to_timestamp(F.substring(created_at, 5, 30), F.lit(CREATED_AT_FORMAT))


def _fields(items: Column, field: str) -> Column:
    return F.transform(items, lambda x: x.getField(field))


def _post_columns() -> list[Column]:
    ent = F.col("entities")
    return [
        parse_created_at(F.col("created_at")).alias("ts"),
        "created_at",
        F.col("id").alias("post_id"),
        F.coalesce("retweeted_status.text", "text").alias("text"),
        _fields(ent["hashtags"], "text").alias("hashtags"),
        _fields(ent["user_mentions"], "screen_name").alias("users"),
        _fields(ent["urls"], "expanded_url").alias("urls"),
        F.coalesce(_fields(ent["media"], "media_url"),
                   F.array().cast("array<string>")).alias("media_urls"),
        F.col("user.followers_count").alias("n_followers"),
        F.col("user.friends_count").alias("n_friends"),
    ]


def extract_posts(raw: DataFrame, lang: str = "en") -> DataFrame:
    """Posts of one language in the fixed post layout; broken rows and those lacking a required field are dropped."""
    return language_filter(raw, lang).filter(F.col(_CORRUPT).isNull()).select(*_post_columns()).dropna(how="any")


def sorted_lines(raw: DataFrame, lang: str = "en") -> DataFrame:
    """Each line of the language, or of none, once: its `kind`, post or reject, the post columns as far as they could
    be read, the names of those `missing`, and the broken `line` where there is one."""
    names = ["lang", *POST_SCHEMA.fieldNames()]
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in names])
    good = (F.col("missing") == "") & F.col("line").isNull()
    return (raw.filter(F.col(_CORRUPT).isNotNull() | F.col("lang").isNull() | (F.col("lang") == lang))
            .select("lang", *_post_columns(), F.col(_CORRUPT).alias("line"))
            .withColumn("missing", missing)
            .select(F.when(good, POST).otherwise(REJECT).alias("kind"), *POST_SCHEMA.fieldNames(), "missing", "line"))


def rejected_posts(raw: DataFrame, lang: str = "en") -> DataFrame:
    """What `extract_posts` drops as malformed, with the broken line where there is one.

    Each line of the language, or of none, is either here or among the extracted posts.
    """
    return sorted_lines(raw, lang).filter(F.col("kind") == REJECT).select("post_id", "missing", "line")


def first_by_post_id(posts: DataFrame) -> DataFrame:
    """One row per post id, the earliest."""
    cols = posts.columns
    row = F.struct(*cols)
    return (posts.groupBy("post_id").agg(F.min_by(row, F.struct("ts", "text")).alias("_row"))
            .select(*[F.col("_row")[c].alias(c) for c in cols]))


def write_posts(posts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, one folder per event date, so that later scans prune by day."""
    (posts.withColumn("event_date", F.to_date("ts"))
     .write.mode(mode).partitionBy("event_date").parquet(path))


def write_sorted_lines(lines: DataFrame, path: str, batch: str, mode: str = "overwrite") -> None:
    """Rows of `sorted_lines` as Parquet, in one job over one scan: one folder per kind, batch and event date.

    With `overwrite`, the folders that the rows fall into are replaced and others stay: a batch that is run
    again leaves what the first run left, and other batches are not touched.
    """
    (lines.withColumns({"batch": F.lit(batch), "event_date": F.to_date("ts")})
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch", "event_date").parquet(path))


# tables without kinds hold posts only
_STORED = T.StructType([*POST_SCHEMA.fields, T.StructField("kind", T.StringType())])


def _is_post() -> Column:
    return F.coalesce(F.col("kind"), F.lit(POST)) == POST


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rejected lines of a table that `write_sorted_lines` wrote."""
    schema = "post_id long, missing string, line string, kind string"
    return spark.read.schema(schema).parquet(path).filter(F.col("kind") == REJECT).select("post_id", "missing", "line")


def read_posts(spark: SparkSession, path: str, first_day: str | None = None,
               last_day: str | None = None) -> DataFrame:
    """Extracted posts; with days given, only the folders of those dates are listed and read."""
    posts = spark.read.schema(_STORED).parquet(path).filter(_is_post())
    if first_day is not None:
        posts = posts.filter(F.col("event_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        posts = posts.filter(F.col("event_date") <= F.lit(last_day).cast("date"))
    return posts.select(*POST_SCHEMA.fieldNames())


def read_posts_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_STORED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).filter(_is_post()).select(*POST_SCHEMA.fieldNames())
