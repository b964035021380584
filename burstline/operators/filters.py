"""Row filters and the per-post token columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.functions import text as tx
from burstline.functions.words import SPAM_PHRASES, STOP_WORDS
from burstline.lineage import cut

# letters in a row by which phrases without a word inside are found
_GRAM = 4


def spam_filter(posts: DataFrame, phrases: Sequence[str] = SPAM_PHRASES) -> DataFrame:
    """Drop posts whose text holds one of the phrases, case-sensitively."""
    if not phrases:
        return posts
    return posts.filter(~reduce(or_, [F.col("text").contains(p) for p in phrases]))


def spam_filter_by_table(posts: DataFrame, phrases: DataFrame) -> DataFrame:
    """The same with phrases of a table `phrases(phrase)` of any size.

    A text can only hold a phrase if it holds each word inside it as a whole word (or, of phrases of one or two
    words, each run of letters). Each phrase is found under the rarest of these, counted over the texts; the
    few texts that share it are then compared with the phrase itself.
    """
    phrases = phrases.filter("phrase IS NOT NULL").select("phrase").distinct()
    texts = cut(posts.filter("text IS NOT NULL").select("text").distinct()
                .withColumn("id", F.monotonically_increasing_id()))
    inner = F.filter(F.slice(F.split("phrase", " "), 2, F.greatest(F.size(F.split("phrase", " ")) - 2, F.lit(0))), lambda w: w != "")
    width = F.least(F.length("phrase"), F.lit(_GRAM))
    grams = F.transform(F.sequence(F.lit(1), F.length("phrase") - width + 1), lambda i: F.substring("phrase", i, width))
    keys = cut(phrases.select("phrase", inner.alias("inner"), width.alias("width"), grams.alias("grams")).select(
        "phrase", F.when(F.size("inner") > 0, -1).otherwise(F.col("width")).alias("kind"),
        F.explode(F.array_distinct(F.when(F.size("inner") > 0, F.col("inner")).otherwise(F.col("grams")))).alias("key")))
    kinds = [r["kind"] for r in keys.select("kind").distinct().collect()]  # one to six numbers
    if not kinds:
        return posts

    def held(kind: int) -> Column:
        if kind < 0:
            found = F.split("text", " ")
        else:
            starts = F.sequence(F.lit(1), F.length("text") - kind + 1)
            found = F.when(F.length("text") >= kind, F.transform(starts, lambda i: F.substring("text", i, F.lit(kind))))
        return F.transform(F.array_distinct(found), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    wanted = keys.select("kind", "key").distinct()
    indexed = cut(texts.select("id", F.explode(F.flatten(F.array(*[F.coalesce(held(k), F.array().cast(
        "array<struct<kind:int,key:string>>")) for k in kinds]))).alias("k")).select("id", "k.*").join(wanted, ["kind", "key"], "left_semi"))
    counts = indexed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    # a key that no text holds rules its phrase out
    rarest = (keys.join(counts, ["kind", "key"], "left").groupBy("phrase", "kind")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
              .filter("k.n > 0").select("phrase", "kind", "k.key"))
    spam = (indexed.join(rarest, ["kind", "key"]).select("id", "phrase").join(texts, "id")
            .filter(F.col("text").contains(F.col("phrase"))).select("text").distinct())
    return posts.filter("text IS NOT NULL").join(spam, "text", "left_anti").select(*posts.columns)


def with_tokens_by_table(posts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """`with_tokens` with stop words of a table `stop_words(word)` of any size: an anti-join of words and tags."""
    rows = cut(posts.withColumn("_row", F.monotonically_increasing_id()))
    words = F.filter(F.split(tx.normalized_text(F.col("text")), tx.SPACE_PATTERN), lambda w: F.length(w) > 1)

    def items(array: Column, is_word: bool) -> Column:
        return F.transform(array, lambda t, i: F.struct(F.lit(is_word).alias("is_word"), i.alias("i"), t.alias("token")))

    each = tx.with_columns_once(rows, said=words).select("_row", F.explode(F.concat(
        items(F.col("said"), True), items(F.array_distinct("hashtags"), False))).alias("t"))
    stop = stop_words.filter("word IS NOT NULL").select("word").distinct()
    kept = (each.join(stop, F.lower("t.token") == F.col("word"), "left_anti").groupBy("_row")
            .agg(F.array_sort(F.collect_list("t")).alias("kept")))

    def of(is_word: bool) -> Column:
        chosen = F.filter("kept", lambda t: t["is_word"] == is_word)
        return F.coalesce(F.transform(chosen, lambda t: t["token"]), F.array().cast("array<string>"))

    worded = rows.join(kept, "_row", "left").withColumns({"words": of(True), "_tags": of(False)})
    return worded.withColumn("bag", tx.token_bag(F.col("users"), F.col("_tags"), F.col("words"), [])).select(
        *posts.columns, "words", "bag")


def with_tokens(posts: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Add `words` (content words of the text) and `bag` (mentions, tags, words)."""
    words = tx.content_words(tx.normalized_text(F.col("text")), stop_words)
    worded = tx.with_columns_once(posts, words=words)
    return tx.with_columns_once(
        worded, bag=tx.token_bag(F.col("users"), F.col("hashtags"), F.col("words"), stop_words))


def is_eligible() -> Column:
    """Whether a post has few mentions and tags, enough words, and not all in capitals."""
    joined = F.array_join("words", " ")
    return ((F.size("users") < 3) & (F.size("hashtags") < 3)
            & (F.size("words") > 3) & (F.size("bag") >= 4)
            & (F.upper(joined) != joined))


def eligible_posts(tokens: DataFrame) -> DataFrame:
    return tokens.filter(is_eligible())
