import hashlib
from collections import defaultdict

from burstline.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tests.llm.cases import CLASHING, LOWER, as_text, table, texts


def test_against_brute_force(spark):
    rows = texts()
    for fan_in, keep in ((2, "largest"), (8, "smallest")):
        got = exact_duplicates(table(spark, rows), keep=keep, fan_in=fan_in).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[(t or "").translate(LOWER)].append(i)
        want = []
        for i, t in rows:
            g = groups[(t or "").translate(LOWER)]
            ids = [x for x in g if x is not None]
            best = (max(ids) if keep == "largest" else min(ids)) if ids else None
            want.append((i, best, len(g), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
        assert as_text((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == as_text(want)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.kept <= (r.doc_id == r.keep_id) for r in got if r.keep_id is not None)


def test_filter_keeps_one_row_a_group_and_all_columns(spark):
    docs = table(spark, texts())
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and set(CLASHING) <= set(left.columns)
    seen = [(r.text or "").translate(LOWER) for r in left.collect()]
    assert len(seen) == len(set(seen)) == len({(t or "").translate(LOWER) for _, t in texts()})


def test_empty_table(spark):
    docs = table(spark, texts()).limit(0)
    assert exact_duplicates(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0
