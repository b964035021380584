import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstline.llm.hard_negatives import MiningParams, integer_vectors, mine

SCHEMA = "vec_id long, embedding array<float>, label int, row string, rank string, anchor string, vector string, slice string"


def vectors(seed=1, n=400, dims=13, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = (centres[label] * 0.7 + rng.normal(size=dims) * 0.8).astype(np.float32).tolist()
        out.append((i, v, label))
    out += [(n + i, out[5][1], i % labels) for i in range(60)]  # one vector many times
    out += [(0, out[9][1], 1), (50, out[50][1], out[50][2]), (None, out[3][1], 2), (None, [1.0] * dims, 1)]
    out += [(900, None, 1), (950, [1.0] * (dims - 1) + [None], 1), (1000, [math.nan] + [1.0] * (dims - 1), 1),
            (1050, [math.inf] * dims, 2), (1100, [-1.0] * dims, None), (1150, [0.0] * dims, 0), (1200, [1.0, 2.0], 1),
            (1250, [], 3)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * 5) for r in rows], SCHEMA).repartition(3)


def brute(rows, every=50, params=MiningParams()):
    used = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for k, (i, a, label) in enumerate(used):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), math.inf if j is None else j, j, other)
                  for m, (j, v, other) in enumerate(used) if m != k]
        scored.sort(key=lambda s: s[:2])
        for p, _, j, _ in [s for s in scored if s[3] == label][:params.positives]:
            fit = [s for s in scored if s[3] != label
                   and params.low_percent * -p <= 100 * -s[0] <= params.high_percent * -p][:params.negatives]
            out += [(i, j, r, s[2], -p, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(map(str, out))


def got_rows(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"slice_rows": 37, "group_anchors": 3}])
def test_equals_brute_force(spark, sizes):
    rows = vectors()
    got = got_rows(mine(integer_vectors(frame(spark, rows)), is_anchor=F.col("id") % 50 == 0, **sizes))
    assert got == brute(rows) and len(got) > 50


def test_huge_components_and_other_limits(spark):
    rng = random.Random(4)
    # sums beyond what doubles hold exactly
    rows = [(i, [float(rng.randrange(-10**6, 10**6)) for _ in range(9)], i % 3) for i in range(150)]
    params = MiningParams(positives=2, negatives=7, low_percent=1, high_percent=120)
    got = got_rows(mine(integer_vectors(frame(spark, rows)), is_anchor=F.col("id") % 10 == 0, params=params))
    assert got == brute(rows, 10, params) and len(got) > 50


def test_no_rows_no_anchors(spark):
    docs = frame(spark, vectors())
    assert mine(integer_vectors(docs.limit(0)), is_anchor=F.col("id") % 50 == 0).count() == 0
    assert mine(integer_vectors(docs), is_anchor=F.col("id") < 0).count() == 0
