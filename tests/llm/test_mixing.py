from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from burstline.llm.mixing import MixParams, keep_mixed, leaf_budgets, mix
from tests.llm.cases import CLASHING, table, texts


def columns():
    return {"domain": F.when(F.col("source").isin("src0", "src1"), "a").otherwise("b"), "language": F.col("lang"),
            "source": F.col("source")}


def shared(budget, children):
    """Budgets of children (room, weight) by filling them up step by step."""
    given, left, open_ = {}, Fraction(budget), dict(children)
    while open_:
        weight = sum(w for _, w in open_.values())
        full = {k for k, (room, w) in open_.items() if room <= left * w / weight}
        if not full:
            return given | {k: int(left * w / weight) for k, (_, w) in open_.items()}
        for k in full:
            given[k] = open_[k][0]
            left -= open_.pop(k)[0]
    return given


@pytest.mark.parametrize("share", [10, 60, 130, 500])
def test_budgets_against_filling_step_by_step(spark, share):
    leaves = {("a", "en", "s1"): 900, ("a", "en", "s2"): 100, ("a", "de", "s1"): 50, ("b", "en", "s1"): 4000,
              ("b", "fr", "s1"): 3, ("b", "fr", "s2"): 0, ("c", "en", "s9"): 777}
    params = MixParams(share_percent=share, max_epochs=2, weights={"domain": {"a": 3, "c": 0}, "source": {"s2": 2}})
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, language string, source string, tokens long")
    got = {(r.domain, r.language, r.source): r.budget for r in leaf_budgets(df, params).collect()}
    room = {k: 2 * n for k, n in leaves.items() if n and k[0] != "c"}
    weight = lambda level, name: params.weights.get(level, {}).get(name, 1)
    want = {}

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            want[prefix] = budget
            return
        names = sorted({k[depth] for k in room if k[:depth] == prefix})
        level = ("domain", "language", "source")[depth]
        rooms = {n: (sum(v for k, v in room.items() if k[:depth + 1] == (*prefix, n)), weight(level, n)) for n in names}
        for n, b in shared(budget, rooms).items():
            down((*prefix, n), b)

    down((), min(sum(leaves.values()) * share // 100, sum(room.values())))
    assert got == want


def test_prefixes_fill_the_budgets(spark):
    rows, params = texts(11), MixParams(share_percent=70, max_epochs=2)
    docs = table(spark, rows)
    got = mix(docs, params=params, **columns()).collect()
    taken, seen = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.tokens_taken <= r.n_tokens and r.epoch < 2
        taken[(r.domain, r.language, r.source)] += r.tokens_taken
        seen[r.doc_id] += 1
    size = lambda t: 0 if not t else t.count(" ") + t.count("\n") + 1
    total = sum(size(t) for _, t in rows)
    assert total * 0.7 - 40 <= sum(taken.values()) <= total * 0.7
    again = mix(docs.repartition(5), params=params, **columns()).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_filter(spark):
    docs = table(spark, texts(11))
    left = keep_mixed(docs, params=MixParams(share_percent=50, max_epochs=1), **columns())
    assert left.columns == docs.columns and set(CLASHING) <= set(left.columns)
    assert 0 < left.count() < docs.count()
    everything = keep_mixed(docs, params=MixParams(share_percent=100, max_epochs=1), **columns())
    # leaves without tokens have no budget
    assert everything.where("length(text) > 0").count() == docs.where("length(text) > 0").count()
    assert keep_mixed(docs.limit(0), **columns()).count() == 0 and mix(docs.limit(0), **columns()).count() == 0
