import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from burstline.llm import bwt_dedup
from burstline.llm.bwt_dedup import RepeatParams, remove_repeats, suffix_order
from tests.llm.cases import as_text, table, texts


def brute(rows, length):
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k:k + length], key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < key(i):
                gone[k:k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_against_brute_force(spark):
    rows = texts(4)
    for params in (RepeatParams(), RepeatParams(length=64, task_bytes=4096, key_bytes=4096, common=3, often=2)):
        got = remove_repeats(table(spark, rows), params=params).collect()
        assert as_text((*r[:4], bytes(r.kept)) for r in got) == as_text(brute(rows, params.length))
    assert any(r.n_removed for r in got)


def test_no_rows_and_short_rows(spark):
    assert remove_repeats(table(spark, texts()).limit(0)).count() == 0
    got = remove_repeats(table(spark, [(1, "a"), (2, None), (3, "a")])).collect()
    assert as_text((r.doc_id, r.n_removed) for r in got) == as_text([(1, 0), (2, 0), (3, 0)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12))
def test_columns_give_the_suffix_order(segments):
    ends = np.cumsum([len(s) for s in segments])
    places = suffix_order(np.frombuffer(b"".join(segments), np.uint8), ends)
    whole = [(s[k:], i) for i, s in enumerate(segments) for k in range(len(s) + 1)]
    got = []
    for k, p in enumerate(places):
        i = k if k < len(ends) else int(np.searchsorted(ends, p, side="right"))
        got.append(b"" if k < len(ends) else b"".join(segments)[p:ends[i]])
    assert got == [s for s, _ in sorted(whole)]


def test_many_columns_are_written_in_one_pass(monkeypatch):
    rng = np.random.default_rng(5)
    segments = [bytes(rng.integers(0, 4, n).astype(np.uint8)) for n in rng.integers(1, 60, 80)]
    segments += [s[5:] for s in segments if len(s) > 5]
    passes = []
    ranked = bwt_dedup._ranked
    monkeypatch.setattr(bwt_dedup, "_ranked", lambda *a: passes.append(1) or ranked(*a))
    monkeypatch.setattr(bwt_dedup, "_NEAR", 50)  # symbols are put in order over many blocks
    data, ends = np.frombuffer(b"".join(segments), np.uint8), np.cumsum([len(s) for s in segments])
    places = suffix_order(data, ends)
    assert len(passes) <= 60 // bwt_dedup._COLUMNS + 2
    want = sorted((s[k:], i, k) for i, s in enumerate(segments) for k in range(len(s)))
    assert places[len(ends):].tolist() == [int(ends[i]) - len(segments[i]) + k for _, i, k in want]
