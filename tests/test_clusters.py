import datetime as dt

import numpy as np
import pytest
from brute import average_linkage, cosine_distances, near_copies, profile_distances
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.operators import distance as ds
from burstline.operators import features as ft
from burstline.operators import linkage as lk

START = dt.datetime(2024, 1, 1)


def windows_of(seed):
    rng = np.random.default_rng(seed)
    shapes = [(40, 3, 10, .0, 6), (60, 5, 9, .08, 12), (50, 2, 14, .2, 8), (30, 8, 8, .05, 30),
              (70, 4, 12, .03, 5), (12, 1, 7, .3, 3)]
    return {i: near_copies(rng, *s) for i, s in enumerate(shapes)}


def pruned_frame(spark, windows):
    rows = [(w, w * 1000 + i, START + dt.timedelta(seconds=w * 1000 + i), terms)
            for w, posts in windows.items() for i, terms in enumerate(posts)]
    return spark.createDataFrame(rows, "window_id long, post_id long, ts timestamp, terms array<string>")


@pytest.mark.parametrize("seed,block_rows", [(1, 512), (2, 7)])
def test_distances_and_clusters_equal_dense_results(spark, seed, block_rows):
    windows = windows_of(seed)
    pruned = pruned_frame(spark, windows)
    pats = cut(ft.patterns(pruned))
    vecs = cut(ds.vectors(pats))
    extremes = cut(ds.block_extremes(vecs, block_rows=block_rows))
    cuts = cut(ds.distance_cut(extremes))
    pairs = cut(ds.near_pairs(vecs, extremes, cuts))
    dist = cut(ds.profile_distances(ds.profile_space(vecs, pairs), pairs))
    # half the windows count as small, the others go through the rounds
    small = 0 if seed == 1 else 30
    labels = lk.cluster_patterns(pats, small_window=small, block_rows=block_rows)
    every = ft.pattern_of_post(pruned, pats).join(labels, ["window_id", "pattern_id"]).toPandas()
    cut_of = {r.window_id: r for r in cuts.collect()}
    weights = {(r.window_id, r.pattern_id): r.n_posts for r in pats.collect()}
    pairs = dist.toPandas()
    merged = 0
    for w, posts in windows.items():
        d = cosine_distances(posts)
        e = profile_distances(d)
        assert cut_of[w].max_distance == pytest.approx(d.max(), abs=1e-9)
        limit = .5 * d.max()
        mine = pairs[pairs.window_id == w]
        for r in mine.itertuples():
            i, j = r.x - w * 1000, r.y - w * 1000
            assert r.d == pytest.approx(d[i, j], abs=1e-9)
            assert r.e == pytest.approx(e[i, j], abs=1e-6)
        ids = sorted(p - w * 1000 for v, p in weights if v == w)
        expected = {(i + w * 1000, j + w * 1000) for i in ids for j in ids if i < j and d[i, j] <= limit / np.sqrt(
            weights[w, i + w * 1000] + weights[w, j + w * 1000]) - 1e-8}
        assert expected <= set(zip(mine.x, mine.y))
        close_dense = {(i + w * 1000, j + w * 1000) for i in ids for j in ids if i < j and e[i, j] <= limit - 1e-6}
        assert close_dense <= set(zip(mine.x, mine.y))
        merged += len(close_dense)
        got = every[every.window_id == w].groupby("cluster_id").post_id.apply(
            lambda s: frozenset(int(x) - w * 1000 for x in s))
        assert set(got) == average_linkage(e, limit)
        for name, group in got.items():
            assert name == w * 1000 + min(group)
    assert merged > 0


@pytest.mark.parametrize("share", [.5, 1.0])
def test_no_near_pair_is_missed_with_opposite_posts(spark, share):
    rng = np.random.default_rng(11)
    terms = [f"t{i}" for i in range(12)]
    windows = {}
    for w in range(30):  # halves of the vocabulary against each other: cosines down to -1
        half = set(rng.choice(12, 6, replace=False).tolist())
        posts = [[t for i, t in enumerate(terms) if (i in half) == side] for side in (True, False) for _ in range(2)]
        posts += [sorted(rng.choice(terms, rng.integers(2, 9), replace=False).tolist()) for _ in range(5)]
        windows[w] = posts
    pats = cut(ft.patterns(pruned_frame(spark, windows)))
    vecs = cut(ds.vectors(pats))
    extremes = cut(ds.block_extremes(vecs, share))
    cuts = cut(ds.distance_cut(extremes, share))
    found = ds.near_pairs(vecs, extremes, cuts).toPandas()
    weights = {(r.window_id, r.pattern_id): r.n_posts for r in pats.collect()}
    for w, posts in windows.items():
        d = cosine_distances(posts)
        ids = sorted(p - w * 1000 for v, p in weights if v == w)
        want = {(i + w * 1000, j + w * 1000) for i in ids for j in ids if i < j and d[i, j] <= share * d.max() / np.sqrt(
            weights[w, i + w * 1000] + weights[w, j + w * 1000]) - 1e-8}
        mine = found[found.window_id == w]
        assert want <= set(zip(mine.x, mine.y))


def lopsided(rng, n, vocab):
    """Posts of very different length over terms of very different frequency."""
    weight = 1 / np.arange(1, vocab + 1)
    weight /= weight.sum()
    return [sorted({f"t{k:03d}" for k in rng.choice(vocab, rng.integers(3, 30), p=weight)}) for _ in range(n)]


def test_cells_leave_few_blocks_to_compare(spark):
    rng = np.random.default_rng(5)
    windows = {0: lopsided(rng, 900, 150), 1: lopsided(rng, 40, 60), 2: [["a", "b"], ["c", "d"]]}
    vecs = cut(ds.vectors(ft.patterns(pruned_frame(spark, windows))))
    blocks, pairs = ds.block_pairs(vecs, block_rows=8)
    kept = {r.window_id: r.n for r in pairs.groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    number = {r.window_id: r.n for r in blocks.groupBy("window_id").agg(F.countDistinct("block").alias("n")).collect()}
    cells = {r.window_id: r.n for r in blocks.groupBy("window_id").agg(F.countDistinct("cell").alias("n")).collect()}
    assert cells[0] > 20 and cells[2] == 1 and max(cells.values()) <= 256
    assert kept[0] < .2 * number[0] * (number[0] + 1) / 2, (kept, number)
    found = {r.window_id: r.max_distance for r in ds.distance_cut(ds.block_extremes(vecs, block_rows=8)).collect()}
    for w, posts in windows.items():
        assert found[w] == pytest.approx(cosine_distances(posts).max(), abs=1e-9)


def test_long_posting_lists_meet_part_by_part(spark, monkeypatch):
    rng = np.random.default_rng(6)
    posts = near_copies(rng, 120, 2, 9, .1, 5)
    pats = ft.patterns(pruned_frame(spark, {0: posts}))
    vecs = cut(ds.vectors(pats))
    extremes = cut(ds.block_extremes(vecs))
    cuts = cut(ds.distance_cut(extremes))
    whole = sorted(ds.near_pairs(vecs, extremes, cuts).collect())
    monkeypatch.setattr(ds.posting_pairs, "__defaults__", (3,))
    assert [r[:3] for r in sorted(ds.near_pairs(vecs, extremes, cuts).collect())] == [r[:3] for r in whole] and len(whole) > 20


def test_means_bound_the_distance_of_clusters(spark, monkeypatch):
    rng = np.random.default_rng(8)
    windows = {w: near_copies(rng, 70, 4, 12, .25, 9) for w in range(3)}
    pats = cut(ft.patterns(pruned_frame(spark, windows)))
    vecs = cut(ds.vectors(pats))
    ids = {w: sorted(r.pattern_id for r in pats.where(F.col("window_id") == w).collect()) for w in windows}
    # clusters of up to eight patterns in order of id, and all pairs of them
    members = spark.createDataFrame([(w, p, ids[w][k // 8 * 8]) for w in windows for k, p in enumerate(ids[w])],
                                    "window_id long, pattern_id long, cluster_id long")
    members = members.join(pats.select("window_id", "pattern_id", "n_posts"), ["window_id", "pattern_id"])
    pairs = spark.createDataFrame([(w, a, b) for w in windows for a in ids[w][::8] for b in ids[w][::8] if a < b],
                                  "window_id long, x long, y long")
    near = spark.createDataFrame([(w, a, b) for w in windows for a in ids[w] for b in ids[w] if a < b],
                                 "window_id long, x long, y long")
    space = ds.profile_space(vecs, near)
    got = {(r.window_id, r.x, r.y): r.e for r in ds.centroid_distances(space, members, pairs).collect()}
    cluster = {(r.window_id, r.pattern_id): (r.cluster_id, r.n_posts) for r in members.collect()}
    for w, posts in windows.items():
        rows = [posts[p - w * 1000] for p in ids[w] for _ in range(cluster[w, p][1])]
        owner = np.array([cluster[w, p][0] for p in ids[w] for _ in range(cluster[w, p][1])])
        d = cosine_distances(rows)
        e = profile_distances(d)
        for (v, x, y), found in got.items():
            if v == w:
                mean = np.linalg.norm(d[owner == x].mean(axis=0) - d[owner == y].mean(axis=0))
                assert found == pytest.approx(mean, abs=1e-6)
                assert found <= e[np.ix_(owner == x, owner == y)].mean() + 1e-6
    limit = float(np.median(list(got.values())))
    asked = pairs.withColumn("cut", F.lit(limit))
    reach = {tuple(r[:3]) for r in lk.within_reach(space, members, asked).collect()}
    assert {k for k, e in got.items() if e <= limit} <= reach and len(reach) < len(got)
    monkeypatch.setattr(lk, "MANY_PAIRS", 10**6)
    assert lk.within_reach(space, members, asked).count() == len(got)


def test_sums_over_groups_rule_pairs_out(spark):
    rng = np.random.default_rng(9)
    windows = {w: near_copies(rng, 90, 5, 14, .15, 12) for w in range(3)}
    vecs = cut(ds.vectors(ft.patterns(pruned_frame(spark, windows))))
    extremes = cut(ds.block_extremes(vecs))
    cuts = cut(ds.distance_cut(extremes))
    pairs = cut(ds.near_pairs(vecs, extremes, cuts))
    kept = {tuple(r) for r in ds.within_bound(vecs, pairs, cuts).select("window_id", "x", "y").collect()}
    every = [tuple(r) for r in pairs.select("window_id", "x", "y").collect()]
    close = 0
    for w, posts in windows.items():
        d = cosine_distances(posts)
        e = profile_distances(d)
        for _, x, y in (p for p in every if p[0] == w):
            if e[x - w * 1000, y - w * 1000] <= .5 * d.max():
                close += 1
                assert (w, x, y) in kept
    assert close <= len(kept) < len(every) - (len(every) - close) / 5, (close, len(kept), len(every))
