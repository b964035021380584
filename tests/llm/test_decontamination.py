import random
import re

import pytest

from burstline.llm.decontamination import contamination, decontaminated, item_windows
from tests.llm.cases import CLASHING, LOWER, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found_words(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def cases(seed=2):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.randrange(10, 40))) for k in range(12)]
    items += [(20, "Ünique ñandú, três"), (21, "solo-word?"), (22, None), (23, ""), (24, "?! ..."), (10, prose(rng, 15)),
              (25, items[3][1]), (26, "la " * 30), (None, prose(rng, 12))]
    docs = [(k, prose(rng, 60)) for k in range(15)]
    for k in range(25):
        i, passage = items[rng.randrange(len(items) - 1)]
        words = (passage or "").split(" ")
        lo = rng.randrange(max(1, len(words) - 9))
        part = " ".join(words[lo:lo + rng.randrange(9, 25)])
        docs.append((100 + k, prose(rng, 20) + rng.choice(["\n", ", ", " é-"]) + part.upper() + rng.choice(["!", "x", "\n", " – "])
                     + prose(rng, 10)))
    docs += [(200, None), (201, ""), (202, "é?ÜNIQUE ñandú --- três.solo"), (203, "ÜNIQUE ñandú"), (204, "Solo_Word"),
             (205, "la " * 400), (206, items[-1][1]), (207, items[5][1] + " " + items[6][1]), (None, items[4][1]),
             (100, items[2][1]), (208, items[0][1] + " " + prose(rng, 30_000) + " " + items[1][1])]
    return docs, items


def brute(docs, items, n=10):
    windows = {}
    for i, text in items:
        words = [w for w, _, _ in found_words(text)]
        size = min(n, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k:k + size]), set()).update([] if i is None else [str(i)])
    out = []
    for d, text in docs:
        words = found_words(text)
        hit, listed = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                key = tuple(w for w, _, _ in words[k:k + size])
                if key in windows:
                    hit.update(range(k, k + size))
                    listed |= windows[key]
        spans = []
        for k in sorted(hit):
            if k - 1 in hit:
                spans[-1] = (spans[-1][0], words[k][2])
            else:
                spans.append((words[k][1], words[k][2]))
        out.append((d, len(words), len(hit), spans, sorted(listed)))
    return out


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, window string")


@pytest.mark.parametrize("limit", [200_000, 5])
def test_equals_brute_force(spark, limit):
    docs, items = cases()
    want = brute(docs, items)
    got = contamination(table(spark, docs), bench(spark, items), max_broadcast=limit).collect()
    rows = [(r.doc_id, r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], r["items"]) for r in got]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    assert sum(bool(r[2]) for r in rows) > 20


@pytest.mark.parametrize("limit", [200_000, 5])
def test_spans_and_documents_go(spark, limit):
    docs, items = cases()
    want = brute(docs, items)
    frame, items = table(spark, docs), bench(spark, items)
    clean = decontaminated(frame, items, whole=True, max_broadcast=limit)
    assert clean.columns == frame.columns and set(CLASHING) <= set(clean.columns)
    assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(
        str(d) for d, w in zip(docs, want) if not w[2])
    cleaned = decontaminated(frame, items, max_broadcast=limit)
    expected = []
    for (d, t), w in zip(docs, want):
        for s, e in reversed(w[3]):
            t = t[:s] + t[e:]
        expected.append(str((d, t)))
    assert cleaned.columns == frame.columns
    assert sorted(str((r.doc_id, r.text)) for r in cleaned.collect()) == sorted(expected)


def test_no_rows_no_items(spark):
    docs, items = cases()
    frame, items = table(spark, docs), bench(spark, items)
    assert contamination(frame.limit(0), items).count() == 0
    assert contamination(frame, items.limit(0)).where("n_hit > 0 OR size(items) > 0").count() == 0
    assert contamination(frame, items.limit(0), max_broadcast=-1).where("n_hit > 0").count() == 0
    assert item_windows(items.where("item_id IN (22, 23, 24)")).count() == 0
