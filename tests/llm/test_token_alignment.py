import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from burstline.llm import token_alignment
from burstline.llm.op13 import PAIR
from burstline.llm.token_alignment import align, align_and_judge, pair_counts
from burstline.llm.tokens import byte_letters
from tests.llm.cases import prose, table, texts

AWKWARD = ["a▁b", "<s>x</s> <|endoftext|> <0x41>", " two  blanks ", "\ta\n\n b", "naïve ﬁ ½ 漢字 😀😀", "it's John's x", "a\0b"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: i for i, c in enumerate(byte_letters())}

    def tokens(text):
        """[(id, first byte, byte after the last)] of both sides; none where a side differs from the text."""
        if not text:
            return [], []
        sides = ([(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
                 [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                  for i in b.encode(text) for p in [b.id_to_piece(i)]])
        out = []
        for side in sides:
            if b"".join(t for _, t in side) != (" " + text).encode():
                return [], []
            at, spans = 0, []
            for i, t in side:
                spans.append((i, at, at + len(t)))
                at += len(t)
            out.append(spans)
        return tuple(out)

    return tokens


def brute(rows, tokens):
    linked, found = [], []
    for _, text in rows:
        a, b = tokens(text)
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [(",".join(str(i) for i, _, e in a if lo < e <= hi) + "|" + ",".join(str(i) for i, _, e in b if lo < e <= hi))
                  for lo, hi in zip([0, *cuts], cuts)]
        linked.append(links)
        found.append((len(a), len(b), len(groups), len(links), ";".join(groups)))
    counts = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = [(i, *f, sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links))
           for (i, _), f, links in zip(rows, found, linked)]
    return out, {(*p, n, n == most[p[0]]) for p, n in counts.items()}


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def small():
    return [(i, t[:600] if t else t) for i, t in texts(4)] + [(1000 + k, t) for k, t in enumerate(AWKWARD)]


def test_equals_brute_force(spark, plain):
    rows = small()
    want, counts = brute(rows, plain)
    docs = table(spark, rows)
    got = align_and_judge(docs, PAIR)
    assert sorted(map(str, (tuple(r) for r in got.select(COLS).collect()))) == sorted(map(str, want))
    assert {tuple(r) for r in pair_counts(align(docs, PAIR), PAIR).collect()} == counts
    digest = align_and_judge(docs, PAIR, sha=F.sha2("groups", 256))
    assert "groups" not in digest.columns
    assert sorted(r.sha for r in digest.collect()) == sorted(hashlib.sha256(w[5].encode()).hexdigest() for w in want)


def test_parts_and_batches_change_nothing(monkeypatch):
    worker = token_alignment.Aligner(PAIR)
    rows = [t for _, t in small() if t] + [prose(random.Random(3), 3000)]
    whole = worker.align(rows)
    monkeypatch.setattr(token_alignment, "_PART", 50)
    assert worker.align(rows) == whole
    alone = [worker.align([t]) for t in rows]
    assert [a["groups"][0] for a in alone] == whole["groups"] and [a["pairs"][0] for a in alone] == whole["pairs"]


def test_texts_that_a_side_does_not_give_back_and_no_rows(spark):
    got = {r.doc_id: r for r in align_and_judge(table(spark, [(1, "a▁b"), (2, None), (3, "")]), PAIR).collect()}
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.values()] == [(0,) * 6 + ("",)] * 3
    assert align_and_judge(table(spark, texts()).limit(0), PAIR).count() == 0


def test_a_text_of_a_megabyte(spark):
    text = prose(random.Random(5), 200_000)
    r, = align_and_judge(table(spark, [(1, text), (2, "x" * 300_000)]), PAIR, groups=F.length("groups")).where("doc_id = 1").collect()
    assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_groups >= 200_000
