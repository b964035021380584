"""Every operator as a query over the plain tables. Each reads whole tables and whole texts.

Windows of an hour and low floors suit the number of posts in these tables; the operators' own
defaults are in `TopicParams`. Distances and weights come out as whole millionths.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.functions import text as tx
from burstline.functions.words import SPAM_PHRASES
from burstline.lineage import cut
from burstline.operators import clusters as cl
from burstline.operators import distance as ds
from burstline.operators import features as ft
from burstline.operators import filters as fl
from burstline.operators import topics as tp
from burstline.operators import weights as wt
from burstline.operators import windows as wn
from burstline.operators.linkage import cluster_patterns
from burstline.params import TopicParams
from burstline.plans import topics as pt
from burstline.sources import posts as ps
from burstline.sources import tables as tb
from burstline.sources import topics as ts

PARAMS = TopicParams(window_minutes=60, min_df_floor=2, cluster_floor=2)
# windows of many hours, for what is worked out block by block
WIDE = replace(PARAMS, window_minutes=240)
EVENT_MINUTES = 15
USER_MINUTES = 24 * 60
TOP_TERMS = 10
# raw lines of posts shorter than this are broken off, as input for the malformed-row rules
SHORT_LINE = 20
# a line that the documents repeat often stands in for spam
PHRASES = [*SPAM_PHRASES, "attion to thanedble"]


def millionths(x: Column) -> Column:
    return F.round(x * 1_000_000).cast("bigint")


def _long(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def _joined(column: str, by: str = " ") -> Column:
    return F.array_join(column, by).alias(column)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.language_filter(tb.document_posts(spark, sf_dir))


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.window_posts(_posts(spark, sf_dir), PARAMS, dedupe=False, spam_phrases=PHRASES)[0]


def _corpus(spark: SparkSession, sf_dir: str, params: TopicParams = PARAMS) -> pt.Corpus:
    # post ids of lines are unique by construction
    return pt.window_corpus(_posts(spark, sf_dir), params, dedupe=False, spam_phrases=PHRASES)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.term_weights(_corpus(spark, sf_dir), tb.capital_words(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str, **more) -> pt.TopicTables:
    corpus = _corpus(spark, sf_dir)
    return pt.TopicTables(corpus, pt.term_weights(corpus, tb.capital_words(spark, sf_dir)), PARAMS, **more)


# -- filters and text -----------------------------------------------------------------------------


def lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("post_id", "lang", "text")


def spam_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.spam_filter(_posts(spark, sf_dir), PHRASES).select("post_id", "text")


def display_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("post_id", tx.display_text(F.col("text")).alias("shown"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("post_id", tx.normalized_text(F.col("text")).alias("normalized"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.with_tokens(_posts(spark, sf_dir)).select("post_id", _joined("words"))


def token_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.with_tokens(_posts(spark, sf_dir)).select("post_id", _joined("bag", ","))


def spam_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without the phrases of a table, and of the list."""
    listed = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    phrases = tb.item_phrases(spark, sf_dir).unionByName(listed)
    return fl.spam_filter_by_table(_posts(spark, sf_dir), phrases).select("post_id", "text")


def bag_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token bags without the stop words of a table."""
    return fl.with_tokens_by_table(_posts(spark, sf_dir), tb.short_words(spark, sf_dir)).select(
        "post_id", _joined("words"), _joined("bag", ","))


def deduped_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of which some come again, earlier or later and with another text: the earliest of each id."""
    posts = _posts(spark, sf_dir).select("post_id", "ts", "text")
    later = posts.filter("post_id % 3 = 0").select("post_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
                                                   F.lit("later").alias("text"))
    earlier = posts.filter("post_id % 5 = 0").select("post_id", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"),
                                                     F.concat("text", F.lit(" earlier")).alias("text"))
    same = posts.filter("post_id % 7 = 0").select("post_id", "ts", F.concat(F.lit("  "), "text").alias("text"))
    every = posts.unionByName(later).unionByName(earlier).unionByName(same)
    return ps.first_by_post_id(every).select("post_id", F.unix_timestamp("ts").alias("second"), "text")


def eligible_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.eligible_posts(fl.with_tokens(_posts(spark, sf_dir))).select("post_id", _joined("bag", ","))


# -- raw posts ------------------------------------------------------------------------------------


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts as raw JSON lines: those with a page are reposts, short ones are broken off."""
    p = tb.document_posts(spark, sf_dir)
    repost = F.size("media_urls") > 0
    items = lambda array, field: F.transform(array, lambda x: F.struct(x.alias(field)))
    raw = F.struct(
        "lang", F.date_format("ts", "'Mon' MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        F.col("post_id").alias("id"),
        F.when(repost, F.lit("RT")).otherwise(F.col("text")).alias("text"),
        F.struct((F.col("post_id") % 1000).alias("followers_count"), F.lit(1).alias("friends_count")).alias("user"),
        F.when(repost, F.struct("text")).alias("retweeted_status"),
        F.struct(items("hashtags", "text").alias("hashtags"), items("users", "screen_name").alias("user_mentions"),
                 items("media_urls", "expanded_url").alias("urls"),
                 F.when(repost, items("media_urls", "media_url")).alias("media")).alias("entities"))
    line = F.to_json(raw)
    return p.select(F.when(F.length("text") < SHORT_LINE, F.substring(line, 1, 30)).otherwise(line).alias("value"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.extract_posts(ps.parse_raw_lines(_raw_lines(spark, sf_dir)))


def raw_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("post_id", "text", "n_followers", "n_friends")


def raw_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken lines, by the kind of text they start with."""
    rejected = ps.rejected_posts(ps.parse_raw_lines(_raw_lines(spark, sf_dir)))
    return rejected.groupBy(F.substring("line", 1, 12).alias("start")).agg(F.count(F.lit(1)).alias("n"))


def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines broken in many ways: each is a post or a reject, with what it lacks."""
    lines = _raw_lines(spark, sf_dir).filter(F.endswith("value", F.lit("}")))
    kind = F.pmod(F.get_json_object("value", "$.id").cast("long"), F.lit(8))
    value = (F.when(kind == 1, F.concat("value", F.lit(" and more")))
             .when(kind == 2, F.concat("value", F.lit("}")))
             .when(kind == 3, F.regexp_replace("value", '"lang":"[a-z]*",', ""))
             .when(kind == 4, F.regexp_replace("value", '"created_at":"[^"]*"', '"created_at":"yesterday"'))
             .when(kind == 5, F.regexp_replace("value", '"user":\\{[^}]*\\}', '"user":{"followers_count":3}'))
             .when(kind == 6, F.concat(F.lit("["), "value", F.lit("]")))
             .otherwise(F.col("value")))
    sorted_ = ps.sorted_lines(ps.parse_raw_lines(lines.select(value.alias("value"))))
    number = F.coalesce("post_id", F.regexp_extract("line", '"id":([0-9]+)', 1).cast("long"))
    return sorted_.select(number.alias("post_id"), "kind", F.col("line").isNotNull().alias("broken"),
                          F.when(F.col("line").isNull(), F.col("missing")).otherwise("").alias("missing"))


def entity_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(
        "post_id", *[_joined(c, ",") for c in ("hashtags", "users", "urls", "media_urls")])


def created_at_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("post_id", F.unix_timestamp("ts").alias("second"))


# -- windows --------------------------------------------------------------------------------------


def aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir).select(
        "post_id", "window_id", wn.window_label(F.col("window_id")).alias("window_label"))


def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored windows of posts, without closing posts and the open tail."""
    windowed, sequence = pt.window_posts(_posts(spark, sf_dir), PARAMS, anchored=True, dedupe=False,
                                         spam_phrases=PHRASES)
    return windowed.join(sequence, "window_id").select(
        "post_id", "window_id", _long("window_seq"))


def anchored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tb.table(spark, sf_dir, "events").select("event_id", "ts")
    return wn.anchored_windows(events, EVENT_MINUTES).select("event_id", "window_id")


def anchored_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored windows of each user's events, numbered, without closing events and open tails."""
    events = tb.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("post_id"), "ts")
    windowed = cut(wn.anchored_windows(events, USER_MINUTES, by="user_id"))
    sequence = wn.window_sequence(windowed, PARAMS.history_windows, by="user_id")
    kept = wn.drop_triggers(wn.drop_open_tail(windowed, by="user_id"), by="user_id")
    return kept.join(sequence, ["user_id", "window_id"]).select(
        "user_id", F.col("post_id").alias("event_id"), "window_id", *[_long(c) for c in ("window_seq", "block", "place")])


def anchored_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = pt.window_corpus(_posts(spark, sf_dir), PARAMS, anchored=True, dedupe=False, spam_phrases=PHRASES)
    return corpus.stats().drop("window_start")


def window_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    windowed = _windowed(spark, sf_dir)
    return wn.window_sequence(windowed, PARAMS.history_windows).select(
        "window_id", *[_long(c) for c in ("window_seq", "block", "place")])


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).stats().drop("window_start")


# -- terms ----------------------------------------------------------------------------------------


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fl.eligible_posts(fl.with_tokens(_windowed(spark, sf_dir)))
    return ft.post_terms(posts).select("window_id", "post_id", "term")


def min_df_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).vocab


def pruned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).pruned.select("window_id", "post_id", _joined("terms", "|"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).patterns.select("window_id", "pattern_id", "n_posts")


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return ft.term_df(corpus.patterns, corpus.vocab)


def history_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    mean = wt.history_mean(ft.term_df(corpus.patterns, corpus.vocab), corpus.sequence)
    return mean.select("window_id", "term", "df", millionths(F.col("avg_df")).alias("avg_df"))


def burst_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("window_id", "term", millionths(F.col("weight")).alias("weight"))


def boosted_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("window_id", "term", millionths(F.col("boosted")).alias("boosted"))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _weights(spark, sf_dir).withColumn("boosted", F.round("boosted", 9))
    return wt.top_terms(rounded, TOP_TERMS).select(
        "window_id", _long("rank"), "term",
        millionths(F.col("boosted")).alias("boosted"))


# -- distances ------------------------------------------------------------------------------------


def _near(spark: SparkSession, sf_dir: str, params: TopicParams = PARAMS,
          block_rows: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    vecs = cut(ds.vectors(_corpus(spark, sf_dir, params).patterns))
    extremes = cut(ds.block_extremes(vecs, PARAMS.cut_share, block_rows))
    cuts = cut(ds.distance_cut(extremes, PARAMS.cut_share))
    return vecs, cuts, ds.near_pairs(vecs, extremes, cuts)


def near_pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of wide windows, found block by block."""
    return _near(spark, sf_dir, WIDE, 64)[2].select("window_id", "x", "y", millionths(F.col("d")).alias("d"))


def distance_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = cut(ds.vectors(_corpus(spark, sf_dir).patterns))
    cuts = ds.distance_cut(ds.block_extremes(vecs, PARAMS.cut_share), PARAMS.cut_share)
    return cuts.select("window_id", millionths(F.col("max_distance")).alias("max_distance"),
                       millionths(F.col("cut")).alias("cut"))


def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[2].select("window_id", "x", "y", millionths(F.col("d")).alias("d"))


def profile_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs, _, pairs = _near(spark, sf_dir)
    pairs = cut(pairs)
    return ds.profile_distances(ds.profile_space(vecs, pairs), pairs).select(
        "window_id", "x", "y", millionths(F.col("e")).alias("e"))


# -- clusters and topics --------------------------------------------------------------------------


def post_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).post_clusters().select("window_id", "post_id", "cluster_id")


def post_clusters_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters with every window in the rounds that large windows go through."""
    return _tables(spark, sf_dir, small_window=0).post_clusters().select("window_id", "post_id", "cluster_id")


def post_clusters_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of wide windows, by the rounds."""
    corpus = _corpus(spark, sf_dir, WIDE)
    labels = cluster_patterns(corpus.patterns, WIDE.cut_share, 0, 64)
    return cl.post_clusters(corpus.pruned, corpus.patterns, labels).select("window_id", "post_id", "cluster_id")


def topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).topic_sizes().select(
        "window_id", _long("topic"), "n_headlines", "n_posts", millionths(F.col("score")).alias("score"), _long("rank"), "listed")


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).cluster_sizes()


def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).scores.select(
        "window_id", "cluster_id", "size", millionths(F.col("score")).alias("score"), _long("rank"))


def cluster_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).headlines.select("window_id", _long("rank"), "post_id", _joined("bag", ","))


def headline_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.headline_distances(_tables(spark, sf_dir).headlines).select(
        "window_id", _long("x"), _long("y"), millionths(F.col("d")).alias("d"))


def headline_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.headline_topics(_tables(spark, sf_dir).headlines, PARAMS).select(
        "window_id", _long("rank"), _long("topic"))


def topics_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_columns(_tables(spark, sf_dir, small_window=0).topics)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_columns(_tables(spark, sf_dir).topics)


def _topic_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "window_id", "window_label", _long("rank"), millionths(F.col("score")).alias("score"), "headline", "label",
        *[F.array_join(F.col(c).cast("array<string>"), ", ").alias(c)
          for c in ("keywords", "post_ids", "media_urls")])


def topic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.topic_lines(_tables(spark, sf_dir).topics)


ALL = [
    lang_filter, spam_filter, spam_by_table, display_clean, normalized_text, tokens, token_bag, bag_by_table,
    deduped_posts, eligible_posts,
    raw_ingest, raw_rejects, sorted_lines, entity_arrays, created_at_parse,
    aligned_windows, anchored_windows, anchored_events, anchored_users, window_sequence, window_stats,
    anchored_window_stats,
    ngrams, min_df_vocabulary, pruned_posts, copies, term_df, history_mean, burst_weight,
    boosted_weight, top_terms,
    distance_cut, pair_cosine, near_pairs_wide, profile_distance,
    post_clusters, post_clusters_rounds, post_clusters_wide, topic_sizes, cluster_sizes, cluster_scores, cluster_headlines, headline_cosine,
    headline_topics, topics, topics_rounds, topic_lines,
]
QUERIES = {f.__name__: f for f in ALL}
