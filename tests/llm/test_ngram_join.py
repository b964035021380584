from collections import defaultdict

import numpy as np
import pytest

from burstline.llm.ngram_join import CountTree, JoinParams, linked_documents, needed, one_of_each_group, point, possible, unpacked
from tests.llm.cases import CLASHING, as_text, shingles, table, texts


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in groups[find(k)] if x is not None]
        out.append((i, len(sets[k]), min(ids) if ids and sets[k] else i))
    return out


@pytest.mark.parametrize("params", [JoinParams(), JoinParams(size=2, percent=60, groups=16, leaf=4)])
def test_against_brute_force(spark, params):
    rows = texts(6)
    got = linked_documents(table(spark, rows), params=params).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows, params.size, params.percent)
    assert as_text(got) == as_text(want)
    assert len({w[2] for w in want}) < len(want) - 10


def test_one_of_each_group(spark):
    rows = texts(6)
    docs = table(spark, rows)
    left = one_of_each_group(docs)
    assert left.columns == docs.columns and set(CLASHING) <= set(left.columns)
    want = brute(rows, 4, 85)
    kept = {w[2] for w in want if w[1]}
    got = [r.doc_id for r in left.collect() if shingles(r.text, 4)]
    assert set(got) == kept and len(got) == len(kept) + 1  # one id has two texts
    assert left.where("text IS NULL OR trim(text) = ''").count() > 0
    assert one_of_each_group(docs.limit(0)).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 60, rng.integers(20, 300)).astype(np.uint64) for _ in range(120)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 60, 3).astype(np.uint64)]) for s in sets]
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(unpacked([point(s, 16) for s in sets], 16), sizes)
    x, y = tree.pairs(tree, 80)
    found = set(zip(x.tolist(), y.tolist()))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= needed(len(sets[a]), len(sets[b]), 80):
                assert (a, b) in found


def _shared_and_possible(sets, percent):
    a, b = np.triu_indices(len(sets), 1)
    points = [point(s, JoinParams().groups) for s in sets]
    n = np.array([len(s) for s in sets])
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    return (both >= needed(n[a], n[b], percent),
            possible([points[i] for i in a], [points[j] for j in b], n[a], n[b], percent))


def test_variants_that_are_not_alike_enough_are_ruled_out():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    variants = [np.concatenate([rng.permutation(text)[30:], rng.integers(0, 1 << 60, 30).astype(np.uint64)]) for _ in range(60)]
    linked, found = _shared_and_possible([np.unique(v) for v in variants], 80)
    assert not linked.any() and found.mean() < 0.05


def test_bound_loses_no_pair_of_large_sets():
    rng = np.random.default_rng(5)
    large = rng.integers(0, 1 << 60, 300_000).astype(np.uint64)  # groups beyond 4 bits
    fewer = rng.integers(0, 1 << 60, 1500).astype(np.uint64)
    sets = [large, large[:270_000], large[15_000:], fewer, fewer[:1300], fewer[250:]]
    linked, found = _shared_and_possible([np.unique(s) for s in sets], 80)
    assert linked.sum() >= 4 and found[linked].all() and not found[[2, 3, 4]].any()
