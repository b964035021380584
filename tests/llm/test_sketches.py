import hashlib

import numpy as np

from burstline.llm.hashing import shingles_of, words_of
from burstline.llm.sketches import (compare_with_next, containment, distinct_shingles, fingerprint, from_text, merged,
                                    resemblance, sketch, sketches_of, to_text)
from tests.llm.cases import shingles, table, texts


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_ring_of_edited_texts(spark):
    rows = texts(9)
    for per_bucket in (1000, 7):
        got = compare_with_next(table(spark, rows), rows_per_bucket=per_bucket).collect()
        ring = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
        want, near = [], {}
        for k, (i, t) in enumerate(ring):
            t, n = t or "", ring[(k + 1) % len(ring)][1] or ""
            half = len(t) // 2
            e = t[:len(t) - half] + n[:half]
            key = (i, len(t), hashlib.sha256(e.encode()).hexdigest())
            want.append(key)
            near[key] = (jaccard(shingles_raw(t), shingles_raw(e)), jaccard(shingles_raw(t), shingles_raw(n)))
        keys = [(r.doc_id, r.n_chars, r.edited_sha256) for r in got]
        assert sorted(map(str, keys)) == sorted(map(str, want))
        for r in got:
            a, b = near[(r.doc_id, r.n_chars, r.edited_sha256)]
            assert abs(r.near_edited - a) < 0.2 and abs(r.near_next - b) < 0.2


def shingles_raw(text):
    """Shingles with case kept, as the operator takes them."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    universe = rng.integers(1, 1 << 62, 30000).astype(np.uint64)
    a, b = universe[:20000], universe[10000:]
    one, two = sketch(a, 512), sketch(b, 512)
    assert (merged(one, two, 512) == sketch(universe, 512)).all()
    assert abs(distinct_shingles(one, 512) / 20000 - 1) < 0.2
    assert abs(resemblance(one, two, 512) - 1 / 3) < 0.08
    assert abs(containment(one, two, 512) - 1 / 2) < 0.1
    assert (from_text(to_text(one)) == one).all()


def test_small_texts_are_exact():
    a, b, c, none = sketches_of(["one two three four five six", "two three four five six seven", "one two", ""])
    assert len(a) == len(b) == 2 and len(c) == 1 and len(none) == 0
    assert resemblance(a, b) == 1 / 3 and resemblance(none, none) == 1 and resemblance(a, none) == 0


def test_words_and_shingles_equal_the_plain_ones():
    rows = [t or "" for _, t in texts(10)]
    made = shingles_of(*words_of([t.encode() for t in rows], lower=True), 5)
    plain = {}
    for t, h in zip(rows, made):
        assert len(np.unique(h)) == len(shingles(t, 5))
        plain.setdefault(shingles(t, 5), set()).add(tuple(np.unique(h).tolist()))
    assert all(len(v) == 1 for v in plain.values())


def test_equal_texts_and_no_rows(spark):
    got = fingerprint(table(spark, [(1, "a b c"), (2, "a b c"), (None, None)])).collect()
    assert len({r.fingerprint for r in got if r.doc_id}) == 1 and len(got) == 3
    docs = table(spark, texts())
    assert compare_with_next(docs.limit(0)).count() == 0 and fingerprint(docs.limit(0)).count() == 0
    alone = compare_with_next(table(spark, [(5, "one two three")])).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(5, 1.0)]
