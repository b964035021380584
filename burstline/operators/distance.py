"""Distances between the posts of a window, without ever holding a posts x posts matrix.

Notation, per window of m posts over terms with share p = df / m (terms with p = 1 carry nothing and
are left out): standardising a 0/1 column gives (b - p) / sqrt(p (1 - p)), so with v = p (1 - p)

    S_ij = sum of 1/v over common terms      a_i = sum of p/v over terms of i      c = sum of p^2/v
    dot_ij = S_ij - a_i - a_j + c            norm_i^2 = S_ii - 2 a_i + c           d_ij = 1 - dot / norms

Posts with equal terms are one weighted pattern (see `features.patterns`).

Clusters are cut in the space of distance profiles, e_ij = |row i of d - row j of d|. Columns i and j
alone give e_ij >= d_ij * sqrt(w_i + w_j), w being the number of copies. So patterns closer than a cut
in profile space are also close by cosine, which an inverted index with prefix filter finds exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.lineage import cut as cut_lineage

# bounds are widened by this much, so that rounding can only add candidates
_SLACK = 1e-9
# cells of a window along each side of the grid that bounds are taken on
_GRID = 16
# groups of posts whose sums bound the distance of profiles
_GROUPS = 128
# the closed form of a distance is exact to about this much
ROUNDING = 1e-6
# postings of a term that meet in one task
_POSTINGS = 2048
# distances are compared after rounding, so that sums in another order decide alike
DIGITS = 9


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, t: acc + value(t))


def _scale(t: Column) -> Column:
    """1 / v of a term."""
    return 1 / (t["p"] * (1 - t["p"]))


def _ids(vec: Column) -> Column:
    return F.transform(vec, lambda t: t["id"])


def _overlap(vec: Column, other_ids: Column) -> Column:
    return _sum(F.filter(vec, lambda t: F.array_contains(other_ids, t["id"])), _scale)


def vectors(pats: DataFrame) -> DataFrame:
    """Patterns as sparse vectors: `vec` lists (id, p) of their terms, rarest first, `ids` and `ps`
    the same as plain arrays.

    Ids number the vocabulary of one window, whose size does not grow with the posts (see
    `features.vocabulary`).
    """
    held = pats.select("window_id", "pattern_id", "n_posts", F.explode("terms").alias("term"))
    sizes = pats.groupBy("window_id").agg(F.sum("n_posts").alias("m"))
    rare_first = Window.partitionBy("window_id").orderBy("df", "term")
    terms = (held.groupBy("window_id", "term").agg(F.sum("n_posts").alias("df"))
             .join(sizes, "window_id").filter(F.col("df") < F.col("m"))
             .select("window_id", "term", (F.col("df") / F.col("m")).alias("p"),
                     F.row_number().over(rare_first).alias("id")))
    centre = terms.groupBy("window_id").agg(F.sum(F.col("p") / (1 - F.col("p"))).alias("c"))
    packed = (held.join(terms, ["window_id", "term"]).groupBy("window_id", "pattern_id")
              .agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("vec")))
    vec = F.col("vec")
    a = _sum(vec, lambda t: 1 / (1 - t["p"]))
    square = _sum(vec, _scale) - 2 * F.col("a") + F.col("c")
    return (pats.select("window_id", "pattern_id", "n_posts")
            .join(packed, ["window_id", "pattern_id"], "left").join(centre, "window_id", "left")
            .withColumn("vec", F.coalesce(vec, F.array().cast("array<struct<id:int,p:double>>")))
            .withColumn("ids", _ids(vec)).withColumn("ps", F.transform(vec, lambda t: t["p"]))
            .withColumn("c", F.coalesce("c", F.lit(0.0)))
            .withColumn("a", a)
            .withColumn("norm", F.sqrt(F.greatest(square, F.lit(0.0)))))


# -- largest distance of a window ---------------------------------------------------------------


def _celled(vecs: DataFrame, block_rows: int) -> DataFrame:
    """Lay the patterns of a window on a grid of (`a`, log of `norm`), in cells of some blocks on average.

    The grid has at most `_GRID` x `_GRID` cells, however many patterns there are; small windows are one cell.
    """
    ranges = vecs.groupBy("window_id").agg(
        F.least(F.floor(F.sqrt(F.count(F.lit(1)) / F.lit(block_rows))), F.lit(_GRID)).cast("int").alias("_g"),
        F.min("a").alias("_a0"), F.max("a").alias("_a1"),
        F.min(F.log("norm")).alias("_n0"), F.max(F.log("norm")).alias("_n1"))

    def place(x: Column, low: str, high: str) -> Column:
        width = F.greatest(F.col(high) - F.col(low), F.lit(1e-12))
        return F.least(F.floor(F.col("_g") * (x - F.col(low)) / width), F.col("_g") - 1)

    row, column = place(F.col("a"), "_a0", "_a1"), place(F.log("norm"), "_n0", "_n1")
    return (vecs.join(ranges, "window_id")
            .withColumn("cell", F.when(F.col("_g") > 1, row * _GRID + column).otherwise(F.lit(0)).cast("long"))
            .drop("_g", "_a0", "_a1", "_n0", "_n1"))


def _blocked(celled: DataFrame, block_rows: int) -> DataFrame:
    """Spread the patterns of a cell over blocks of about `block_rows`, by their commonest term."""
    keyed = celled.withColumn("head", F.coalesce(F.get(F.reverse("ids"), F.lit(0)), F.lit(0)))
    before = (Window.partitionBy("window_id", "cell").orderBy("head")
              .rowsBetween(Window.unboundedPreceding, -1))
    heads = (keyed.groupBy("window_id", "cell", "head").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    place = F.col("_offset") + F.pmod(F.xxhash64("pattern_id"), F.col("_n"))
    return (keyed.join(heads, ["window_id", "cell", "head"])
            .withColumn("block", F.shiftleft(F.col("cell"), 32) + F.floor(place / block_rows)).drop("_n", "_offset"))


def _summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Ranges of `a` and 1 / `norm` of groups of patterns, and the pattern whose row is likely furthest from others."""
    u = 1 / F.col("norm")
    return rows.groupBy("window_id", *keys).agg(
        F.first("c").alias("c"), F.min("a").alias("a0"), F.max("a").alias("a1"),
        F.min(u).alias("u0"), F.max(u).alias("u1"), F.min("head").alias("h0"), F.max("head").alias("h1"),
        F.max_by(F.struct("vec", "ids", "a", "norm"), F.struct(F.col("a") * u, "pattern_id")).alias("rep"))


def _side(summary: DataFrame, side: str) -> DataFrame:
    return summary.select("window_id", *[F.col(x).alias(f"{side}_{x}") for x in summary.columns if x != "window_id"])


def _bounded(pairs: DataFrame, *keep: str) -> DataFrame:
    """Bounds of the cosine over pairs of groups `l_` and `r_`: (low, high, rep_cos).

    Of two patterns without a common term the cosine is (c - a_i - a_j) / norms; with common terms
    it is larger. Ranges of a and norm bound it per pair of groups, and the cosine of one actual
    pair shows which bounds cannot win.
    """
    c = F.col("l_c")
    head_shared = (F.col("l_h0") == F.col("l_h1")) & (F.col("l_h1") == F.col("r_h0")) & (
        F.col("r_h0") == F.col("r_h1")) & (F.col("l_h0") > 0)
    head_p = F.element_at(F.col("l_rep.vec"), -1)
    shared = F.when(head_shared, _scale(head_p)).otherwise(F.lit(0.0))
    low = c - F.col("l_a1") - F.col("r_a1") + shared
    high = c - F.col("l_a0") - F.col("r_a0")
    largest, smallest = F.col("l_u1") * F.col("r_u1"), F.col("l_u0") * F.col("r_u0")
    rep_cos = ((_overlap(F.col("l_rep.vec"), F.col("r_rep.ids")) - F.col("l_rep.a") - F.col("r_rep.a")
                + c) / (F.col("l_rep.norm") * F.col("r_rep.norm")))
    return pairs.select(
        "window_id", *keep,
        F.when(low < 0, low * largest).otherwise(low * smallest).alias("low"),
        F.when(high > 0, high * largest).otherwise(F.lit(0.0)).alias("high"),
        rep_cos.alias("rep_cos"))


def _that_matter(bounds: DataFrame) -> DataFrame:
    """Pairs that can hold the smallest cosine, or near posts without a common term."""
    return bounds.filter((F.col("low") <= F.col("seen") + _SLACK)
                         | (F.col("high") >= 1 - F.col("widest") / F.sqrt(F.lit(2.0)) - _SLACK))


def block_pairs(vecs: DataFrame, cut_share: float = 0.5, block_rows: int = 512) -> tuple[DataFrame, DataFrame]:
    """The blocks of each window, and the pairs of them that must be compared: (window_id, l_block, r_block, widest).

    Cells of the grid are compared with cells first, a bounded number a window; blocks meet only where the
    bounds of their cells leave something to find, and are then judged by bounds of their own.
    """
    celled = _celled(vecs.filter(F.col("norm") > 0), block_rows)
    cells = cut_lineage(_summary(celled.withColumn("head", F.lit(0)), "cell"))
    cell_pairs = _side(cells, "l").join(_side(cells, "r"), "window_id").filter("l_cell <= r_cell")
    bounds = _bounded(cell_pairs, "l_cell", "r_cell")
    best = bounds.groupBy("window_id").agg(F.min("rep_cos").alias("seen"), F.min("low").alias("least"))
    widest = F.lit(cut_share) * (1 - F.greatest("least", F.lit(-1.0)))
    kept = _that_matter(bounds.join(best, "window_id").withColumn("widest", widest)).select(
        "window_id", "l_cell", "r_cell", "seen", "widest")

    blocks = cut_lineage(_blocked(celled, block_rows))
    summary = _summary(blocks, "cell", "block")
    pairs = (kept.join(_side(summary, "l"), ["window_id", "l_cell"]).join(_side(summary, "r"), ["window_id", "r_cell"])
             .filter("l_block <= r_block"))
    bounds = _bounded(pairs, "l_block", "r_block", "seen", "widest")
    nearer = bounds.groupBy("window_id").agg(F.min("rep_cos").alias("_seen"))
    bounds = bounds.join(nearer, "window_id").withColumn("seen", F.least("seen", "_seen"))
    return blocks, _that_matter(bounds).select("window_id", "l_block", "r_block", "widest")


def cosine_block(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Cosine distances between the rows of two blocks of one window."""
    overlap, d = _overlap_and_distance(left, right)
    return d


def profile_matrix(d: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Distances between the rows of a small distance matrix, each column counted `copies` times."""
    return np.stack([np.sqrt(((d - row) ** 2) @ copies) for row in d])


def _overlap_and_distance(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    vocab = np.unique(np.concatenate([np.array([], dtype=np.int32), *left["ids"], *right["ids"]]))
    overlap = _dense(left, vocab) @ _dense(right, vocab).T
    dot = overlap - left["a"].to_numpy()[:, None] - right["a"].to_numpy()[None, :] + left["c"].iloc[0]
    norms = np.outer(left["norm"], right["norm"])
    return overlap, 1 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def _dense(pdf: pd.DataFrame, vocab: np.ndarray) -> np.ndarray:
    out = np.zeros((len(pdf), len(vocab)))
    rows = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["ids"]])
    if len(rows):
        ids, p = np.concatenate(pdf["ids"].to_list()), np.concatenate(pdf["ps"].to_list())
        # 1/sqrt(v), so that the product of two rows is S
        out[rows, np.searchsorted(vocab, ids)] = 1 / np.sqrt(p * (1 - p))
    return out


def _compare_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The smallest cosine between two blocks, and near pairs without a common term."""
    window_id, l_block, r_block = key
    left, right = (pdf[pdf["block"] == b].sort_values("pattern_id") for b in (l_block, r_block))
    overlap, d = _overlap_and_distance(left, right)
    cos = 1 - d
    if l_block == r_block:
        np.fill_diagonal(cos, 1.0)
    wl, wr, xl, xr = (x[c].to_numpy() for c in ("n_posts", "pattern_id") for x in (left, right))
    i, j = np.unravel_index(np.argmin(cos), cos.shape)
    reach = pdf["widest"].iloc[0] / np.sqrt(wl[:, None] + wr[None, :])
    near = (overlap == 0) & (1 - cos <= reach + _SLACK)
    near &= (xl[:, None] < xr[None, :]) if l_block == r_block else True
    ni, nj = np.nonzero(near)
    return pd.DataFrame({
        "window_id": window_id,
        "x": np.concatenate([[xl[i]], xl[ni]]), "y": np.concatenate([[xr[j]], xr[nj]]),
        "cos": np.concatenate([[cos[i, j]], cos[ni, nj]]),
        "apart": np.concatenate([[False], np.ones(len(ni), dtype=bool)]),
    })


def block_extremes(vecs: DataFrame, cut_share: float = 0.5, block_rows: int = 512) -> DataFrame:
    """Rows (window_id, x, y, cos, apart): the smallest cosine of each pair of blocks compared, and
    with `apart` the near pairs that have no term in common.

    A task holds two blocks. Pairs of blocks whose bound cannot matter are not compared.
    """
    blocks, pairs = block_pairs(vecs, cut_share, block_rows)
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("l_block", "r_block"))).alias("block"))
    rows = sides.join(blocks, ["window_id", "block"]).select(
        "window_id", "l_block", "r_block", "block", "widest", "pattern_id", "n_posts", "a", "norm", "c",
        "ids", "ps")
    return rows.groupBy("window_id", "l_block", "r_block").applyInPandas(
        _compare_blocks, "window_id long, x long, y long, cos double, apart boolean")


def distance_cut(extremes: DataFrame, cut_share: float = 0.5) -> DataFrame:
    """Per window the largest cosine distance between two posts, and the share of it clusters are cut at."""
    return (extremes.groupBy("window_id").agg((1 - F.min("cos")).alias("max_distance"))
            .withColumn("cut", F.col("max_distance") * cut_share))


# -- near pairs -----------------------------------------------------------------------------------


def near_pairs(vecs: DataFrame, extremes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pairs of patterns x < y with cosine distance d <= cut / sqrt(copies of x and y).

    Prefix filter: to be that near, the common terms of a post with any other must weigh at least
    `need`; so, taking terms rarest first, the first common term lies before the point where the
    rest of either post weighs less than that. Only those terms are indexed. A long list of postings is
    split into parts that meet part by part, so no task holds a whole list. Lists hold scalars
    only: at their first common term, the lighter rest of the two bounds what a pair can have in common; vectors are
    fetched for pairs that pass. Near pairs without a common term come from `extremes`.
    """
    least = vecs.groupBy("window_id").agg(
        F.min("norm").alias("n0"), F.max("norm").alias("n1"), F.min("a").alias("a0"))
    bounded = vecs.filter(F.col("norm") > 0).join(least, "window_id").join(cuts, "window_id")
    cos_needed = 1 - F.col("cut") / F.sqrt(F.col("n_posts") + 1)
    # a negative cosine is furthest from zero with the longest partner
    partner = F.when(cos_needed < 0, F.col("n1")).otherwise(F.col("n0"))
    need = (cos_needed * F.col("norm") * partner + F.col("a") + F.col("a0") - F.col("c")) * (1 - _SLACK) - _SLACK
    # weights of the rest from each term on: the rest only gets lighter, so the indexed terms are a leading run
    vec = F.col("vec")
    rests = F.transform(vec, lambda t, k: F.struct(
        t["id"].alias("id"), _sum(F.slice(vec, k + 1, F.size(vec)), _scale).alias("rest")))
    postings = (bounded.withColumn("need", need)
                .withColumn("t", F.explode(F.filter(rests, lambda t: t["rest"] >= F.col("need"))))
                .select("window_id", "t.id", "t.rest", "c", "cut", "pattern_id", "n_posts", "a", "norm"))
    candidates = posting_pairs(postings)

    def side(name: str) -> DataFrame:
        return vecs.select("window_id", *[F.col(c).alias(f"{name}_{c}") for c in ("n_posts", "vec", "ids", "a", "norm")],
                           F.col("pattern_id").alias(name))

    both = (candidates.join(side("x"), ["window_id", "x"]).join(side("y"), ["window_id", "y"])
            .join(cuts, "window_id").join(vecs.groupBy("window_id").agg(F.first("c").alias("c")), "window_id"))
    d = 1 - (_overlap(F.col("x_vec"), F.col("y_ids")) - F.col("x_a") - F.col("y_a") + F.col("c")) / (
        F.col("x_norm") * F.col("y_norm"))
    shared = (both.withColumn("d", d)
              .filter(F.col("d") <= F.col("cut") / F.sqrt(F.col("x_n_posts") + F.col("y_n_posts")) + _SLACK)
              .select("window_id", "x", "y", "d"))

    copies = vecs.select("window_id", "pattern_id", "n_posts")
    apart = (extremes.filter("apart").join(cuts, "window_id")
             .join(copies.select("window_id", F.col("pattern_id").alias("x"), F.col("n_posts").alias("wx")),
                   ["window_id", "x"])
             .join(copies.select("window_id", F.col("pattern_id").alias("y"), F.col("n_posts").alias("wy")),
                   ["window_id", "y"])
             .filter(1 - F.col("cos") <= F.col("cut") / F.sqrt(F.col("wx") + F.col("wy")) + _SLACK)
             .select("window_id", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
                     (1 - F.col("cos")).alias("d")))
    return shared.unionByName(apart)


def posting_pairs(postings: DataFrame, part_rows: int = _POSTINGS) -> DataFrame:
    """Distinct pairs (window_id, x, y) of patterns that meet in a list and whose rests may weigh enough.

    `postings` lists patterns under terms (window_id, id) with the weight of their `rest` from that term on. Lists are
    counted before the join, and long ones cut into parts of about `part_rows`.
    """
    lists = (postings.groupBy("window_id", "id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
             .select("window_id", "id", F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts")))
    placed = postings.join(lists, ["window_id", "id"]).withColumn(
        "_part", F.pmod(F.xxhash64("pattern_id"), F.col("_parts")).cast("int"))

    def side(name: str, first: Column, second: Column) -> DataFrame:
        return placed.select("window_id", "id", first.alias("_first"), second.alias("_second"), *(
            ["c", "cut"] if name == "l" else []), *[F.col(x).alias(f"{name}_{x}") for x in ("pattern_id", "n_posts", "a", "norm", "rest")])

    left = side("l", F.col("_part"), F.explode(F.sequence("_part", F.col("_parts") - 1)))
    right = side("r", F.explode(F.sequence(F.lit(0), "_part")), F.col("_part"))
    cos_needed = 1 - F.col("cut") / F.sqrt(F.col("l_n_posts") + F.col("r_n_posts"))
    most = F.least("l_rest", "r_rest") * (1 + _SLACK) + _SLACK - F.col("l_a") - F.col("r_a") + F.col("c")
    one, other = F.col("l_pattern_id"), F.col("r_pattern_id")
    return (left.join(right, ["window_id", "id", "_first", "_second"])
            .filter((one != other) & ((F.col("_first") < F.col("_second")) | (one < other)))
            .filter(most >= cos_needed * F.col("l_norm") * F.col("r_norm") * F.when(cos_needed < 0, 1 + _SLACK).otherwise(1 - _SLACK))
            .select("window_id", F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct())


# -- profile distance -----------------------------------------------------------------------------


@dataclass(frozen=True)
class ProfileSpace:
    """What profile distances between some patterns of each window need.

    `points` holds those patterns, `common` per pair of their terms the sum of 1 / norm^2 over the
    posts that have both, `totals` a few sums over all posts of the window.
    """

    points: DataFrame
    common: DataFrame
    totals: DataFrame


def profile_space(vecs: DataFrame, pairs: DataFrame) -> ProfileSpace:
    """Prepare profile distances between the patterns that occur in `pairs`."""
    used = (pairs.select("window_id", F.explode(F.array("x", "y")).alias("pattern_id"))
            .distinct())
    vec = F.col("vec")
    points = vecs.join(used, ["window_id", "pattern_id"], "left_semi")
    wanted = points.select("window_id", F.explode("ids").alias("id")).distinct()
    w = F.col("n_posts") / (F.col("norm") * F.col("norm"))
    weighted = (vecs.filter(F.col("norm") > 0).join(wanted.select("window_id").distinct(), "window_id", "left_semi")
                .withColumn("w", w))
    totals = weighted.groupBy("window_id").agg(
        F.first("c").alias("c"), F.sum("w").alias("g"), F.sum(F.col("w") * F.col("a")).alias("r"),
        F.sum(F.col("w") * F.col("a") * F.col("a")).alias("b"))
    held = (weighted.select("window_id", "pattern_id", "w", "a", F.explode("ids").alias("id"))
            .join(wanted, ["window_id", "id"], "left_semi")
            .groupBy("window_id", "pattern_id").agg(
                F.first("w").alias("w"), F.first("a").alias("a"), F.collect_list("id").alias("ids")))
    common = (held.select("window_id", "w", "a", "ids", F.explode("ids").alias("i"))
              .select("window_id", "w", "a", "i", F.explode(F.filter("ids", lambda t: t >= F.col("i"))).alias("j"))
              .groupBy("window_id", "i", "j")
              .agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("a")).alias("wa")))
    common = cut_lineage(common)

    # per pattern the products with the sums that do not depend on its partner
    own = common.filter("i = j").select("window_id", F.col("i").alias("id"), "w", "wa")
    flat = points.select("window_id", "pattern_id", "norm", F.explode(vec).alias("t")).select(
        "window_id", "pattern_id", "norm", F.col("t.id").alias("id"), _scale(F.col("t")).alias("s"))
    products = flat.join(own, ["window_id", "id"]).groupBy("window_id", "pattern_id").agg(
        (F.sum(F.col("s") * F.col("w")) / F.first("norm")).alias("er"),
        (F.sum(F.col("s") * F.col("wa")) / F.first("norm")).alias("em"))
    points = (points.join(products, ["window_id", "pattern_id"], "left").na.fill(0.0, ["er", "em"])
              .withColumn("eq", F.col("a") / F.col("norm"))
              .select("window_id", "pattern_id", "n_posts", "norm", "vec", "ids", "er", "em", "eq"))
    return ProfileSpace(cut_lineage(points), common, cut_lineage(totals))


def within_bound(vecs: DataFrame, pairs: DataFrame, cuts: DataFrame, groups: int = _GROUPS) -> DataFrame:
    """`pairs` but for those whose profiles differ by more than the cut already in a few sums.

    The posts of a window are dealt to groups by their commonest term. A profile's sum over a group, divided by
    the root of the group's size, is its projection on a unit vector, and those of the groups are orthogonal: the
    distance of the projections never exceeds that of the profiles. So what is left out has e > cut, and
    `profile_space` need not be prepared for it.
    """
    held = vecs.filter(F.col("norm") > 0).join(pairs.select("window_id").distinct(), "window_id", "left_semi").withColumn(
        "group", F.pmod(F.coalesce(F.get(F.reverse("ids"), F.lit(0)), F.lit(0)), F.lit(groups)))
    v = F.col("n_posts") / F.col("norm")
    sums = held.groupBy("window_id", "group").agg(
        F.sum("n_posts").alias("m"), F.sum(v).alias("g"), F.sum(v * F.col("a")).alias("r"))
    by_term = (held.select("window_id", "group", v.alias("v"), F.explode("ids").alias("id"))
               .groupBy("window_id", "id", "group").agg(F.sum("v").alias("w")))
    ends = pairs.select("window_id", F.explode(F.array("x", "y")).alias("pattern_id")).distinct()
    points = vecs.join(ends, ["window_id", "pattern_id"], "left_semi")
    met = (points.select("window_id", "pattern_id", F.explode("vec").alias("t"))
           .select("window_id", "pattern_id", F.col("t.id").alias("id"), _scale(F.col("t")).alias("s"))
           .join(by_term, ["window_id", "id"]).groupBy("window_id", "pattern_id", "group")
           .agg(F.sum(F.col("s") * F.col("w")).alias("met")))
    # the dot product with all posts of a group, see the head of this file
    dot = (F.coalesce("met", F.lit(0.0)) - F.col("a") * F.col("g") - F.col("r") + F.col("c") * F.col("g")) / F.col("norm")
    shadows = (points.select("window_id", "pattern_id", "a", "c", "norm").join(sums, "window_id")
               .join(met, ["window_id", "pattern_id", "group"], "left")
               .groupBy("window_id", "pattern_id").agg(F.sort_array(F.collect_list(F.struct(
                   "group", ((F.col("m") - dot) / F.sqrt("m")).alias("q")))).alias("qs"))
               .select("window_id", "pattern_id", F.transform("qs", lambda q: q["q"]).alias("qs")))
    shadows = cut_lineage(shadows)

    def side(end: str) -> DataFrame:
        return shadows.select("window_id", F.col("pattern_id").alias(end), F.col("qs").alias("qs_" + end))

    square = F.aggregate(F.zip_with("qs_x", "qs_y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, t: acc + t)
    return (pairs.join(side("x"), ["window_id", "x"]).join(side("y"), ["window_id", "y"])
            .join(cuts.select("window_id", F.col("cut").alias("_cut")), "window_id")
            .filter(F.sqrt(square) <= F.col("_cut") + ROUNDING).select(*pairs.columns))


def profile_distances(space: ProfileSpace, pairs: DataFrame) -> DataFrame:
    """Add `e`, the distance of the profiles of x and y, to rows (window_id, x, y, ...)."""
    columns = ["norm", "vec", "ids", "er", "em", "eq"]

    def side(name: str) -> DataFrame:
        return space.points.select("window_id", F.col("pattern_id").alias(name),
                                   *[F.col(x).alias(f"{name}_{x}") for x in columns])

    keys = pairs.select("window_id", "x", "y").distinct()
    both = keys.join(side("x"), ["window_id", "x"]).join(side("y"), ["window_id", "y"])
    x_ids, y_ids = F.col("x_ids"), F.col("y_ids")
    gap = 1 / F.col("x_norm") - 1 / F.col("y_norm")

    def part(items: Column, weight: Column) -> Column:
        return F.transform(items, lambda t: F.struct(t["id"].alias("id"), (_scale(t) * weight).alias("z")))

    difference = F.concat(
        part(F.filter("x_vec", lambda t: F.array_contains(y_ids, t["id"])), gap),
        part(F.filter("x_vec", lambda t: ~F.array_contains(y_ids, t["id"])), 1 / F.col("x_norm")),
        part(F.filter("y_vec", lambda t: ~F.array_contains(x_ids, t["id"])), -1 / F.col("y_norm")),
    )
    shown = both.select("window_id", "x", "y", difference.alias("zs"), gap.alias("gap"),
                        *[(F.col(f"x_{n}") - F.col(f"y_{n}")).alias(n) for n in ("er", "eq", "em")])
    return pairs.join(_profile_lengths(space, shown), ["window_id", "x", "y"])


def _profile_lengths(space: ProfileSpace, differences: DataFrame) -> DataFrame:
    """(window_id, x, y, e): lengths of differences of profiles.

    A difference is given by its terms `zs` (id, z), and by the differences of er, eq, em and 1 / norm (`gap`). All
    of these are linear in the profiles, so means of profiles serve as well as profiles.
    """
    products = (differences.select("window_id", "x", "y", F.filter("zs", lambda t: t["z"] != 0).alias("zs"))
                .select("window_id", "x", "y", "zs", F.explode("zs").alias("l"))
                .select("window_id", "x", "y", "l",
                        F.explode(F.filter("zs", lambda t: t["id"] >= F.col("l.id"))).alias("r"))
                .select("window_id", "x", "y", F.col("l.id").alias("i"), F.col("r.id").alias("j"),
                        (F.when(F.col("l.id") == F.col("r.id"), 1.0).otherwise(2.0)
                         * F.col("l.z") * F.col("r.z")).alias("z"))
                .join(space.common.select("window_id", "i", "j", "w"), ["window_id", "i", "j"])
                .groupBy("window_id", "x", "y").agg(F.sum(F.col("z") * F.col("w")).alias("quad")))
    er, eq, em, g, r, b, c = (F.col(n) for n in ("er", "eq", "em", "g", "r", "b", "c"))
    shift = -F.col("gap")
    square = (F.coalesce("quad", F.lit(0.0)) - 2 * er * eq + g * eq * eq
              + 2 * shift * (em - er * c - eq * r + g * eq * c)
              + shift * shift * (b - 2 * r * c + g * c * c))
    return (differences.drop("zs").join(products, ["window_id", "x", "y"], "left").join(space.totals, "window_id")
            .select("window_id", "x", "y", F.sqrt(F.greatest(square, F.lit(0.0))).alias("e")))


def centroid_distances(space: ProfileSpace, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(window_id, x, y, e): distance between the mean profiles of the posts of clusters x and y.

    It is never more than the mean distance between their posts. `members` lists (window_id, pattern_id, n_posts,
    cluster_id); the work grows with the members of the clusters asked for, not with pairs of members.
    """
    asked = pairs.select("window_id", F.explode(F.array("x", "y")).alias("cluster_id")).distinct()
    rows = (members.join(asked, ["window_id", "cluster_id"], "left_semi")
            .join(space.points.drop("n_posts"), ["window_id", "pattern_id"]))
    n = F.col("n_posts")

    def mean(x: Column) -> Column:
        return F.sum(n * x) / F.sum("n_posts")

    scalars = rows.groupBy("window_id", "cluster_id").agg(
        F.sum("n_posts").alias("n"), *[mean(F.col(c)).alias(c) for c in ("er", "eq", "em")], mean(1 / F.col("norm")).alias("u"))
    terms = (rows.select("window_id", "cluster_id", n.alias("n"), "norm", F.explode("vec").alias("t"))
             .groupBy("window_id", "cluster_id", F.col("t.id").alias("id"))
             .agg(F.sum(F.col("n") * _scale(F.col("t")) / F.col("norm")).alias("z")))
    means = cut_lineage(terms.join(scalars.select("window_id", "cluster_id", "n"), ["window_id", "cluster_id"])
                        .select("window_id", "cluster_id", "id", (F.col("z") / F.col("n")).alias("z")))
    scalars = cut_lineage(scalars)

    def signed(end: str, sign: int) -> DataFrame:
        return (pairs.select("window_id", "x", "y", F.col(end).alias("cluster_id")).join(means, ["window_id", "cluster_id"])
                .select("window_id", "x", "y", "id", (sign * F.col("z")).alias("z")))

    zs = (signed("x", 1).unionByName(signed("y", -1)).groupBy("window_id", "x", "y", "id").agg(F.sum("z").alias("z"))
          .groupBy("window_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct("id", "z"))).alias("zs")))

    def side(end: str) -> DataFrame:
        return scalars.select("window_id", F.col("cluster_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("er", "eq", "em", "u")])

    none = F.array().cast("array<struct<id:int,z:double>>")
    both = (pairs.select("window_id", "x", "y").join(side("x"), ["window_id", "x"]).join(side("y"), ["window_id", "y"])
            .join(zs, ["window_id", "x", "y"], "left"))
    return _profile_lengths(space, both.select(
        "window_id", "x", "y", F.coalesce("zs", none).alias("zs"), (F.col("x_u") - F.col("y_u")).alias("gap"),
        *[(F.col(f"x_{c}") - F.col(f"y_{c}")).alias(c) for c in ("er", "eq", "em")]))
