"""Batch job: extracted posts to topics, stage by stage.

Steps that several later steps read are cut (written to the shared folder once), when they are first asked for: the
posts, the frequent terms of the eligible ones, the vocabulary, the pruned posts, their patterns, the cluster labels, the headlines and their groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.functions import text as tx
from burstline.functions.words import SPAM_PHRASES, STOP_WORDS
from burstline.lineage import cut, written_tables_freed
from burstline.operators import clusters as cl
from burstline.operators import features as ft
from burstline.operators import filters as fl
from burstline.operators import topics as tp
from burstline.operators import weights as wt
from burstline.operators import windows as wn
from burstline.operators.linkage import SMALL_WINDOW, cluster_patterns
from burstline.params import TopicParams
from burstline.sources.posts import first_by_post_id, read_posts
from burstline.sources.topics import write_topics_tsv


class Corpus:
    """Posts of all windows and what is left of them after each filter. Each table is made when it is first read.

    Without a `sequence`, the windows are those of the posts, and the source is read once.
    """

    def __init__(self, windowed: DataFrame, sequence: DataFrame | None, params: TopicParams,
                 stop_words: Sequence[str] = STOP_WORDS) -> None:
        self.windowed, self._sequence, self.params, self._stop_words = windowed, sequence, params, stop_words

    @cached_property
    def _posts(self) -> DataFrame:
        """All posts; of those that are not eligible no more than the ids."""
        tokens = tx.with_columns_once(fl.with_tokens(self.windowed, self._stop_words),
                                      eligible=F.coalesce(fl.is_eligible(), F.lit(False)))
        return cut(tokens.select("window_id", "post_id", "ts", "eligible", *[
            F.when(F.col("eligible"), F.col(c)).alias(c) for c in ("text", "media_urls", "bag")]))

    @cached_property
    def sequence(self) -> DataFrame:
        if self._sequence is not None:
            return self._sequence
        return wn.window_sequence(self._posts, self.params.history_windows)

    @cached_property
    def eligible(self) -> DataFrame:
        return self._posts.filter("eligible").drop("eligible")

    @cached_property
    def _terms(self) -> DataFrame:
        return cut(ft.frequent_terms(self.eligible, self.params.min_df_floor))

    @cached_property
    def vocab(self) -> DataFrame:
        return cut(ft.vocabulary(self._terms, self.eligible, self.params.min_df_floor, self.params.min_df_share))

    @cached_property
    def pruned(self) -> DataFrame:
        return cut(ft.pruned_posts(self._terms, self.vocab, self.params.min_post_terms))

    @cached_property
    def patterns(self) -> DataFrame:
        return cut(ft.patterns(self.pruned))

    def stats(self) -> DataFrame:
        return ft.window_stats(self.sequence, self._posts, self.eligible, self.vocab, self.pruned)


class TopicTables:
    """All tables of a topic run. Each is made when it is first read."""

    def __init__(self, corpus: Corpus, weights: DataFrame, params: TopicParams, small_window: int = SMALL_WINDOW) -> None:
        self.corpus, self.weights, self.params, self._small_window = corpus, weights, params, small_window

    @cached_property
    def labels(self) -> DataFrame:
        return cut(cluster_patterns(self.corpus.patterns, self.params.cut_share, self._small_window))

    @cached_property
    def scores(self) -> DataFrame:
        return cut(cl.cluster_scores(self.corpus.patterns, self.labels, self.weights, self.params))

    @cached_property
    def headlines(self) -> DataFrame:
        return cut(cl.cluster_headlines(self.scores, self.corpus.eligible))

    @cached_property
    def groups(self) -> DataFrame:
        return cut(tp.headline_topics(self.headlines, self.params))

    @cached_property
    def topics(self) -> DataFrame:
        ranked = cut(tp.topic_scores(self.headlines, self.groups, self.params))
        fallback = tp.media_fallback(ranked, self.corpus.pruned, self.corpus.patterns, self.labels, self.corpus.eligible)
        return tp.topic_rows(ranked, fallback)

    def post_clusters(self) -> DataFrame:
        return cl.post_clusters(self.corpus.pruned, self.corpus.patterns, self.labels)

    def topic_sizes(self) -> DataFrame:
        return tp.topic_sizes(self.headlines, self.groups, self.params)

    def cluster_sizes(self) -> DataFrame:
        return cl.cluster_sizes(self.corpus.patterns, self.labels).select("window_id", "cluster_id", "size")


def window_posts(posts: DataFrame, params: TopicParams, anchored: bool = False,
                 spam_phrases: Sequence[str] = SPAM_PHRASES, dedupe: bool = True,
                 drop_trigger: bool | None = None, drop_tail: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts with their window, and the window sequence.

    Anchored windows lose the post that opens the next window and the last, still open window;
    aligned windows keep both. The two flags override that.
    """
    if dedupe:
        posts = first_by_post_id(posts)
    clean = fl.spam_filter(posts, spam_phrases)
    if anchored:
        clean = cut(clean)  # read for the seconds, the posts, their sequence, the tail and the triggers
        windowed = wn.anchored_windows(clean, params.window_minutes)
    else:
        windowed = wn.aligned_windows(clean, params.window_minutes)
    if drop_tail if drop_tail is not None else anchored:
        windowed = wn.drop_open_tail(windowed)
    # a window counts even if its opening post is all it had
    sequence = wn.window_sequence(windowed, params.history_windows)
    if drop_trigger if drop_trigger is not None else anchored:
        windowed = wn.drop_triggers(windowed)
    return windowed, sequence


def window_corpus(posts: DataFrame, params: TopicParams | None = None, *,
                  stop_words: Sequence[str] = STOP_WORDS, **windowing) -> Corpus:
    params = params or TopicParams()
    windowed, sequence = window_posts(posts, params, **windowing)
    drops = windowing.get("drop_trigger")
    # a window may have lost its only post
    lost = windowing.get("anchored", False) if drops is None else drops
    return Corpus(windowed, sequence if lost else None, params, stop_words)


def term_weights(corpus: Corpus, lexicon: DataFrame | None = None) -> DataFrame:
    df = ft.term_df(corpus.patterns, corpus.vocab)
    return wt.boost_terms(wt.burst_weight(wt.history_mean(df, corpus.sequence)), lexicon)


def detect_topics(posts: DataFrame, params: TopicParams | None = None, *, lexicon: DataFrame | None = None,
                  stop_words: Sequence[str] = STOP_WORDS, small_window: int = SMALL_WINDOW,
                  **windowing) -> TopicTables:
    """All tables of a topic run over extracted posts."""
    params = params or TopicParams()
    corpus = window_corpus(posts, params, stop_words=stop_words, **windowing)
    return TopicTables(corpus, term_weights(corpus, lexicon), params, small_window)


def run(spark: SparkSession, posts_path: str, out_path: str, minutes: float = 15.0,
        mode: str = "errorifexists", *, lexicon: DataFrame | None = None,
        stop_words: Sequence[str] = STOP_WORDS, spam_phrases: Sequence[str] = SPAM_PHRASES) -> None:
    """Anchored windows over an extracted post table, topics as tab-separated text.

    Intermediate tables are deleted when the topics are written.
    """
    with written_tables_freed(spark):
        tables = detect_topics(read_posts(spark, posts_path), TopicParams(window_minutes=minutes), anchored=True,
                               lexicon=lexicon, stop_words=stop_words, spam_phrases=spam_phrases)
        write_topics_tsv(tables.topics, out_path, mode)
