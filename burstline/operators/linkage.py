"""Average-linkage clusters below a cut.

Windows with few patterns are clustered whole, one task per window; the others by rounds of joins
over all of them at once. Both give the same clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.lineage import cut as cut_lineage
from burstline.operators import distance as ds
from burstline.operators.distance import DIGITS, ROUNDING, ProfileSpace, centroid_distances, profile_distances

# patterns of a window that one task clusters by itself
SMALL_WINDOW = 512
# pairs of clusters with so many pairs of patterns are first bounded by their means
MANY_PAIRS = 16


def cluster_patterns(pats: DataFrame, cut_share: float = 0.5, small_window: int = SMALL_WINDOW,
                     block_rows: int = 512) -> DataFrame:
    """The cluster of every pattern: (window_id, pattern_id, cluster_id)."""
    vecs = cut_lineage(ds.vectors(pats))
    counts = vecs.groupBy("window_id").agg(F.count(F.lit(1)).alias("_n"))
    small = counts.filter(F.col("_n") <= small_window).select("window_id")
    large = counts.filter(F.col("_n") > small_window).select("window_id")
    columns = ["window_id", "pattern_id", "n_posts", "a", "norm", "c", "ids", "ps"]
    whole = (vecs.join(small, "window_id", "left_semi").select(*columns).groupBy("window_id")
             .applyInPandas(lambda pdf: _cluster_window(pdf, cut_share),
                            "window_id long, pattern_id long, cluster_id long"))
    if large.isEmpty():
        return whole

    vecs = cut_lineage(vecs.join(large, "window_id", "left_semi"))
    extremes = cut_lineage(ds.block_extremes(vecs, cut_share, block_rows))
    cuts = cut_lineage(ds.distance_cut(extremes, cut_share))
    pairs = cut_lineage(ds.within_bound(vecs, cut_lineage(ds.near_pairs(vecs, extremes, cuts)), cuts))
    space = ds.profile_space(vecs, pairs)
    labels = average_linkage(space, close_pairs(profile_distances(space, pairs), cuts))
    return whole.unionByName(
        vecs.join(labels, ["window_id", "pattern_id"], "left")
        .select("window_id", "pattern_id", F.coalesce("cluster_id", "pattern_id").alias("cluster_id")))


def _cluster_window(pdf: pd.DataFrame, cut_share: float) -> pd.DataFrame:
    pdf = pdf.sort_values("pattern_id")
    copies = pdf["n_posts"].to_numpy(dtype=float)
    d = ds.cosine_block(pdf, pdf)
    np.fill_diagonal(d, 0.0)
    labels = link(ds.profile_matrix(d, copies), copies, cut_share * d.max())
    ids = pdf["pattern_id"].to_numpy()
    return pd.DataFrame({"window_id": pdf["window_id"], "pattern_id": ids, "cluster_id": ids[labels]})


def link(e: np.ndarray, copies: np.ndarray, cut: float) -> np.ndarray:
    """Average linkage of a few weighted points; the label is the first point of the cluster."""
    avg, weight = e.copy(), copies.astype(float).copy()
    np.fill_diagonal(avg, np.inf)
    labels = np.arange(len(e))
    limit = round(float(cut), DIGITS)
    while len(e) > 1:
        rounded = np.round(avg, DIGITS)
        i, j = np.unravel_index(np.argmin(rounded), avg.shape)
        if not rounded[i, j] <= limit:
            break
        i, j = min(i, j), max(i, j)
        joint = (weight[i] * avg[i] + weight[j] * avg[j]) / (weight[i] + weight[j])
        joint[[i, j]] = np.inf
        avg[i, :], avg[:, i] = joint, joint
        avg[j, :], avg[:, j] = np.inf, np.inf
        weight[i] += weight[j]
        labels[labels == j] = i
    return labels


def close_pairs(distances: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pairs (window_id, x, y, e) within the cut of their window."""
    return (distances.join(cuts.select("window_id", "cut"), "window_id")
            .filter(F.round("e", DIGITS) <= F.round("cut", DIGITS)))


def average_linkage(space: ProfileSpace, close: DataFrame) -> DataFrame:
    """Cluster of each pattern that joins another one: (window_id, pattern_id, cluster_id).

    `close` holds the pairs within the cut. Average linkage never brings a merged pair nearer to a
    third cluster than its parts were, so all pairs that are each other's nearest neighbour can be
    merged in the same round, and clusters with no close pair between them never merge: their
    average lies above the cut. Distances beyond the cut count in the averages of clusters that do
    have a close pair; they are worked out when such clusters first meet. A cluster is named after
    its earliest-named pattern.
    """
    weight = space.points.select("window_id", "pattern_id", "n_posts")

    def of(name: str) -> DataFrame:
        return weight.select("window_id", F.col("pattern_id").alias(name), F.col("n_posts").alias("w" + name))

    links = cut_lineage(
        close.join(of("x"), ["window_id", "x"]).join(of("y"), ["window_id", "y"])
        .select("window_id", "x", "y", "wx", "wy", (F.col("wx") * F.col("wy") * F.col("e")).alias("total"), "cut"))
    members = weight.select("window_id", "pattern_id", "n_posts", F.col("pattern_id").alias("cluster_id"))

    while True:
        merges = cut_lineage(_mutual_nearest(links))
        if merges.isEmpty():
            return members.select("window_id", "pattern_id", "cluster_id")
        moved = merges.select("window_id", F.explode(F.array("x", "y")).alias("old"),
                              F.col("x").alias("new"), (F.col("wx") + F.col("wy")).alias("w_new"))
        members = cut_lineage(
            members.join(moved.select("window_id", F.col("old").alias("cluster_id"), "new"),
                         ["window_id", "cluster_id"], "left")
            .select("window_id", "pattern_id", "n_posts", F.coalesce("new", "cluster_id").alias("cluster_id")))
        links = cut_lineage(_relink(space, members, links, moved))


def _mutual_nearest(links: DataFrame) -> DataFrame:
    d = F.round(F.col("total") / (F.col("wx") * F.col("wy")), DIGITS)
    pair = F.struct(d.alias("d"), "x", "y", "wx", "wy")
    return (links.select("window_id", pair.alias("pair"), F.explode(F.array("x", "y")).alias("end"))
            .groupBy("window_id", "end").agg(F.min("pair").alias("pair"))
            .groupBy("window_id", "pair").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
            .select("window_id", "pair.x", "pair.y", "pair.wx", "pair.wy"))


def _relink(space: ProfileSpace, members: DataFrame, links: DataFrame, moved: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return moved.select("window_id", F.col("old").alias(name), F.col("new").alias("new_" + name),
                            F.col("w_new").alias("w_" + name))

    x, y = F.coalesce("new_x", "x"), F.coalesce("new_y", "y")
    wx, wy = F.coalesce("w_x", "wx"), F.coalesce("w_y", "wy")
    renamed = (links.join(side("x"), ["window_id", "x"], "left").join(side("y"), ["window_id", "y"], "left")
               .filter(x != y)
               .select("window_id", "total", "cut", (F.col("wx") * F.col("wy")).alias("known"),
                       F.when(x < y, F.struct(x.alias("x"), y.alias("y"), wx.alias("wx"), wy.alias("wy")))
                       .otherwise(F.struct(y.alias("x"), x.alias("y"), wy.alias("wx"), wx.alias("wy")))
                       .alias("ends")))
    summed = cut_lineage(
        renamed.groupBy("window_id", "ends", "cut")
        .agg(F.sum("total").alias("total"), F.sum("known").alias("known"))
        .select("window_id", "ends.*", "cut", "total", "known"))
    whole = summed.filter(F.col("known") == F.col("wx") * F.col("wy"))
    partial = summed.filter(F.col("known") < F.col("wx") * F.col("wy"))
    columns = ["window_id", "x", "y", "wx", "wy", "total", "cut"]
    out = whole.select(*columns)
    if not partial.isEmpty():
        out = out.unionByName(_full_totals(space, members, partial.drop("total", "known")).select(*columns))
    d = F.round(F.col("total") / (F.col("wx") * F.col("wy")), DIGITS)
    return out.filter(d <= F.round("cut", DIGITS))


def within_reach(space: ProfileSpace, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of clusters but for those of many patterns whose mean profiles already lie further apart than the cut.

    The mean distance between two clusters is at least the distance of their means, so such pairs never merge, and
    the distances between their patterns need not be worked out.
    """
    counts = members.groupBy("window_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))

    def of(end: str) -> DataFrame:
        return counts.select("window_id", F.col("cluster_id").alias(end), F.col("n").alias("patterns_" + end))

    sized = cut_lineage(pairs.join(of("x"), ["window_id", "x"]).join(of("y"), ["window_id", "y"])
                        .withColumn("many", F.col("patterns_x") * F.col("patterns_y") >= MANY_PAIRS))
    many = sized.filter("many")
    if many.isEmpty():
        return pairs
    near = (centroid_distances(space, members, many).join(many.select("window_id", "x", "y", "cut"), ["window_id", "x", "y"])
            .filter(F.col("e") <= F.col("cut") + ROUNDING).select("window_id", "x", "y"))
    kept = many.join(near, ["window_id", "x", "y"], "left_semi")
    return sized.filter("NOT many").unionByName(kept).select(*pairs.columns)


def _full_totals(space: ProfileSpace, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of the profile distances between all posts of two clusters, where those may be within the cut."""
    pairs = within_reach(space, members, pairs)

    def side(cluster: str, pattern: str) -> DataFrame:
        return members.select("window_id", F.col("cluster_id").alias(cluster),
                              F.col("pattern_id").alias(pattern), F.col("n_posts").alias("n_" + pattern))

    each = (pairs.select("window_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
            .join(side("cx", "x"), ["window_id", "cx"]).join(side("cy", "y"), ["window_id", "cy"]))
    totals = (profile_distances(space, each).groupBy("window_id", "cx", "cy")
              .agg(F.sum(F.col("n_x") * F.col("n_y") * F.col("e")).alias("total"))
              .select("window_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "total"))
    return pairs.join(totals, ["window_id", "x", "y"])
