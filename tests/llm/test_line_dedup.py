from burstline.llm.line_dedup import delete_repeated_lines
from tests.llm.cases import as_text, prose, table, texts
import random


def brute(rows, min_words):
    docs = []
    for k, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        at = [p for p, x in enumerate(lines) if x.replace(" ", "")]
        words = [len(lines[p]) - len(lines[p].replace(" ", "")) + 1 for p in at]
        windows = []  # all runs of so many words, however long
        for a in range(len(at)):
            total = 0
            for b in range(a, len(at)):
                total += words[b]
                if total >= min_words:
                    windows.append((a, b, tuple(lines[p] for p in at[a:b + 1])))
        docs.append((i, lines, at, windows))
    first = {}
    for i, _, _, windows in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for a, _, w in windows:
            first.setdefault(w, (i, a))
    out = []
    for i, lines, at, windows in docs:
        gone = {at[x] for a, b, w in windows if first[w] != (i, a) for x in range(a, b + 1)}
        order = [p in gone for p in at]
        runs = sum(g and not (k and order[k - 1]) for k, g in enumerate(order))
        out.append((i, len(lines), len(gone), runs, "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return out


def test_against_brute_force(spark):
    # ids are distinct here: texts under one id come in the order of a hash
    rows = [(k, t) for k, (_, t) in enumerate(texts(2))]
    rng = random.Random(5)
    block = "\n".join(prose(rng, 9) for _ in range(30))
    rows += [(1000 + k, prose(rng, 10) + "\n" + block[40 * k:] + "\n\n" + prose(rng, 30)) for k in range(5)]
    rows += [(2000, block + "\n" + block)]
    got = delete_repeated_lines(table(spark, rows), min_words=20).collect()
    assert as_text(got) == as_text(brute(rows, 20))
    assert any(r.n_removed for r in got)


def test_nothing_of_a_repeated_run_stays(spark):
    rng = random.Random(6)
    copies = []
    for shape in ([60, 8], [8, 60], [10, 22, 93, 2], [3, 49, 1], [1] * 60, [49]):
        passage = "\n".join(prose(rng, n) for n in shape)
        copies += [(shape, prose(rng, 7) + "\n" + passage + "\n" + prose(rng, 9)) for _ in range(3)]
    rows = [(k, t) for k, (_, t) in enumerate(copies)]
    got = {r.doc_id: r for r in delete_repeated_lines(table(spark, rows)).collect()}
    for k, (shape, _) in enumerate(copies):
        gone = len(shape) if k % 3 and sum(shape) >= 50 else 0
        assert (got[k].n_removed, got[k].n_runs) == (gone, int(gone > 0)), (shape, got[k])
    assert as_text(got.values()) == as_text(brute(rows, 50))


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = texts(3)
    got = delete_repeated_lines(table(spark, rows))
    assert got.count() == len(rows)
    assert delete_repeated_lines(table(spark, rows).limit(0)).count() == 0
