"""Tunable values of a topic run, with their standard settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TopicParams:
    window_minutes: float = 15.0
    # vocabulary: df >= max(floor(share * eligible posts), floor)
    min_df_floor: int = 10
    min_df_share: float = 0.0025
    # a post stays when it holds more than this many vocabulary terms
    min_post_terms: int = 4
    # windows per history block
    history_windows: int = 4
    # flat clusters are cut at share * largest cosine distance of the window
    cut_share: float = 0.5
    headline_cut_share: float = 1.0
    # clusters visited by size, and the size they need to be scored
    max_clusters: int = 50
    cluster_floor: int = 10
    cluster_share: float = 0.0025
    # the first cluster below that size stays listed with score 0
    keep_undersized: bool = True
    max_headlines: int = 20
    max_topics: int = 10
