import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from burstline.llm.quality import QualityParams, classify, keep_good
from tests.llm.cases import CLASHING, prose, table, texts


def site():
    return {"host": F.col("source"), "path": F.concat_ws("/", "source", "lang")}


def corpus(seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        words = prose(rng, rng.randrange(20, 150)).split(" ")
        if not good:
            kind = rng.randrange(3)
            words = ([w + rng.choice(["***", "###"]) for w in words] if kind == 0 else
                     [w for w in words[:20] for _ in range(10)] if kind == 1 else [w.upper() + "!!" for w in words])
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels, {i: ok for i, ok, _ in labels}


def test_held_out_accuracy_and_shrinking(spark):
    rows, labels, _ = corpus(1)
    held = [l for l in labels if l[0] % 4 == 1]
    frame = spark.createDataFrame([l for l in labels if l[0] % 4 == 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(table(spark, rows), frame, **site()).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].kept == bool(q) for i, q, _ in held) >= 0.97 * len(held)
    # the posteriors again, in plain Python
    groups = defaultdict(list)
    for r in got.values():
        groups[r.host, r.path].append(r.p_document)
    n = len(got)
    mean = sum(r.p_document for r in got.values()) / n
    for (host, path), p in groups.items():
        of_host = [x for (h, _), xs in groups.items() if h == host for x in xs]
        r = next(r for r in got.values() if (r.host, r.path) == (host, path))
        lo, hi = sorted((mean, sum(of_host) / len(of_host)))
        assert lo - 1e-9 <= r.p_host <= hi + 1e-9
        lo, hi = sorted((r.p_host, sum(p) / len(p)))
        assert lo - 1e-9 <= r.p_path <= hi + 1e-9
    odds = lambda p: math.log(p / (1 - p))
    for r in got.values():
        assert abs(odds(r.probability) - odds(r.p_document) - 0.5 * (odds(r.p_path) - odds(mean))) < 1e-6


def test_noise_that_no_feature_names(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    boiler = "sign up today and save on all our offers click here to read more terms apply see the store for details".split()

    def spoilt(kind):
        n = rng.randrange(30, 120)
        if kind == "gibberish":
            return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))
        if kind == "boilerplate":
            return " ".join(rng.sample(boiler, len(boiler)) + rng.sample(boiler, 10))
        return " ".join(w + rng.choice(kind) * 3 for w in prose(rng, n).split(" "))

    seen = ["gibberish", "boilerplate", "*#"]
    unseen = ["@", "~", "^", "\u00a7\u2020"]
    rows = [(i, prose(rng, rng.randrange(30, 120)), 1) for i in range(400)]
    rows += [(1000 + i, spoilt(seen[i % 3]), 0) for i in range(180)]
    train = [(i, ok, 0) for i, _, ok in rows if i % 2]
    rows += [(2000 + i, spoilt(unseen[i % 4]), 0) for i in range(40)]
    labels = spark.createDataFrame(train, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.p_document >= 0.5 for r in classify(table(spark, [r[:2] for r in rows]), labels, **site()).collect()}
    for kind in (range(0, 1000, 2), range(1000, 2000, 2), range(2000, 3000)):
        held = [(i, bool(ok)) for i, _, ok in rows if i in kind]
        assert sum(got[i] == ok for i, ok in held) >= 0.95 * len(held)


def test_filter_agrees_and_keeps_columns(spark):
    rows, labels, _ = corpus(2)
    frame = spark.createDataFrame(labels + labels[:3] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + texts(3))
    left = keep_good(docs, frame, **site())
    assert left.columns == docs.columns and set(CLASHING) <= set(left.columns)
    judged = classify(docs, frame, **site())
    assert judged.count() == docs.count() and left.count() == judged.where("kept").count()
    assert keep_good(docs.limit(0), frame, **site()).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = table(spark, texts(3))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert keep_good(docs, none, **site()).count() == docs.count()
    bad = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert keep_good(docs, bad, params=QualityParams(max_train_rows=1), **site()).count() == 0


def test_texts_are_judged_once(spark):
    rows, labels, _ = corpus(3)
    left = keep_good(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **site())
    assert left._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
