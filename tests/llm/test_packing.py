import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from burstline.llm import tokens
from burstline.llm.packing import PackParams, Shard, pack
from burstline.llm.tokens import WordTokenizer
from tests.llm.cases import table, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(rows):
    encode = Tokenizer.from_file(PATH).encode
    return [(i, np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]


@pytest.mark.parametrize("params", [PackParams(), PackParams(window=64, shard=16, neighbours=4)])
def test_every_id_lies_in_one_piece(spark, params):
    rows = texts(7)
    got = pack(table(spark, rows), PATH, params=params).collect()
    # rows are told apart by their ids' checksums: pieces of one row lie in a row of starts
    want = defaultdict(int)
    for i, ids in whole(rows):
        want[(i, len(ids))] += len(ids)
    have = defaultdict(int)
    known = defaultdict(list)
    for i, ids in whole(rows):
        known[(i, len(ids))].append(ids)
    sequences = defaultdict(list)
    for r in got:
        have[(r.doc_id, r.doc_tokens)] += r.length
        assert any(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for ids in known[(r.doc_id, r.doc_tokens)])
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    assert have == want
    for pieces in sequences.values():
        at = 0
        for offset, length, size in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == size <= params.window and at & (at - 1) == 0


def test_neighbours_share_windows(spark):
    rows = [(k, f"kalan moris tuzan sapil {'vilum' if k % 2 else 'rezan'} " * 3 + f"u{k}") for k in range(40)]
    got = pack(table(spark, rows), PATH, params=PackParams(window=256)).collect()
    alike = defaultdict(set)
    for r in got:
        alike[r.sequence_id].add(r.doc_id % 2)
    mixed = sum(len(s) > 1 for s in alike.values())
    assert mixed <= len(alike) // 2


def test_no_rows(spark):
    assert pack(table(spark, texts()).limit(0), PATH).count() == 0


def test_tokenizer_with_memory_equals_the_library(monkeypatch):
    rows = [t or "" for _, t in texts(8)]
    rows += ["don't I'LL we've ½ x²y 12 345", "é é ́z ÿŸ Ĳ İstanbul ŉ", "\t a\tb \r\n c\x1cd\x85e\xa0f", "<|startoftext|>a b<|"]
    own, library = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    for memory in (tokens.MEMORY, 1000):
        monkeypatch.setattr(tokens, "MEMORY", memory)
        for _ in range(2):
            ids, bounds = own.encode(rows)
            assert [ids[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == want


def test_neighbours_are_looked_up_until_none_is_left():
    # a hundred short tails share a token with the seed, far more than one lookup offers
    alike = [np.array([7, 100 + k, 7], "<u2") for k in range(100)]
    others = [np.array([9, 400 + k, 9], "<u2") for k in range(200)]
    tails = [alike[0], *[t for pair in zip(others, [*alike[1:], *others[100:]]) for t in pair]]
    idf = np.ones(1000, np.float32)
    shard = Shard(tails, idf, 3.0, PackParams(window=256, neighbours=8))
    pieces = shard.window()
    taken = [tails[i][0] for i, _, _ in pieces]
    assert sum(n for _, _, n in pieces) == 256 and set(taken) == {7}


def test_many_words_go_to_the_model_at_once(monkeypatch):
    rows = ["the quick brown fox", "Der schöne Übermut naïve éé", "x " * 5 + "zzzzqqqq", "it's 2024 ok\nno", "a_b ＡＢ ﬁn İstanbul"]
    own, library = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    alone, encoded = [], own._encoded
    monkeypatch.setattr(own, "_encoded", lambda letters: alone.append(letters) or encoded(letters))
    monkeypatch.setattr(tokens, "_TOGETHER", 3)
    ids, bounds = own.encode(rows)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert not [w for w in alone if w.isalpha() and w.isascii() and len(w) > 2]
