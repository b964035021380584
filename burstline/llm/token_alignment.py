"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and which ids go together.

Both tokenizers cut the bytes of a text into intervals. All intervals of both, sorted by start, are
coalesced: a group ends where the next start reaches the running maximum of ends. Inside a group each
stretch between neighbouring starts is one link, of the token of either side that covers it. How many
documents hold a pair of ids linked is counted over the whole table, and each link is judged by it.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.hashing import batches
from burstline.llm.text import text_or_empty
from burstline.llm.tokens import byte_letters

# texts are cut into segments in parts of about so many characters
_PART = 1 << 20
# no token of either side runs on over a blank that follows something else than white space, so such blanks
# begin segments that are encoded, and aligned, by themselves; all other blanks stay inside a segment
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_INNER_BLANK = regex.compile(r"(?:\A|\s) | \Z")
# segments that are encoded in one call
_RUN = 256
# documents whose texts add up to about so many bytes are counted, and judged, together
CHUNK_BYTES = 4 << 20
_ROW_BYTES = 64


@dataclass(frozen=True)
class TokenizerPair:
    """Two tokenizer files: byte-level (A, of `tokenizers`) and pieces with byte fallback (B, of `sentencepiece`)."""

    byte_level: str
    pieces: str


class _ByteLevel:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        self._encoder.encode_special_tokens = True
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.tokens = [bytes(byte_of[c] for c in self._encoder.id_to_token(i))
                       for i in range(self._encoder.get_vocab_size())]

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._encoder.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]


class _Pieces:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._encoder = SentencePieceProcessor(model_file=path)
        pieces = [self._encoder.id_to_piece(i) for i in range(self._encoder.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece that runs over a blank: texts cannot be encoded in parts")
        self.tokens = [bytes([int(p[3:5], 16)]) if self._encoder.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(pieces)]

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self._encoder.encode(parts, num_threads=1)


class _Numerals:
    """Ids in decimal, each followed by one of three separators, as rows of bytes padded with zeros."""

    SEPARATORS = ",|;"

    def __init__(self, size: int) -> None:
        width = len(str(size)) + 1
        rows = [f"{i}{s}".encode().ljust(width, b"\0") for s in self.SEPARATORS for i in range(size)]
        self._size = size
        self._rows = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
        self._lengths = (self._rows > 0).sum(axis=1)

    def write(self, ids: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
        at = separators * self._size + ids
        raw = self._rows[at]
        return raw[raw > 0].tobytes(), self._lengths[at]


class Aligner:
    """Aligns whole texts by a pair of tokenizers; one a worker."""

    def __init__(self, pair: TokenizerPair) -> None:
        self._sides = (_ByteLevel(pair.byte_level), _Pieces(pair.pieces))
        self._bytes = [np.array([len(t) for t in s.tokens], np.int64) for s in self._sides]
        self.sizes = [len(s.tokens) for s in self._sides]
        self._numerals = _Numerals(max(self.sizes))

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct segments of the texts, and per text its segments by number, in a row with bounds."""
        known: dict[str, int] = {}
        rows, bounds = [np.zeros(0, np.int64)], [0]
        for t in texts:
            start, n = 0, 0
            while start < len(t):
                at = _CUT.search(t, start + _PART) if len(t) - start > _PART else None
                part = t[start:at.start() if at else len(t)]
                start = at.end() if at else len(t)
                found = _segments(part)
                rows.append(np.array([known.setdefault(s, len(known)) for s in found], np.int64))
                n += len(found)
            bounds.append(bounds[-1] + n)
        return list(known), np.concatenate(rows), np.array(bounds)

    def _encode(self, segments: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per side (ids in a row, number of them a segment), and which segments both sides give back byte by byte.

        Segments that a side does not give back have no ids. Segments go to the encoders in runs, joined by
        blanks again; one that ends in white space goes alone, as does each of a run that is not given back.
        """
        runs: list[list[str]] = [[]]
        for s in segments:
            if len(runs[-1]) == _RUN or s[-1:].isspace():
                runs.append([])
            runs[-1].append(s)
            if s[-1:].isspace():
                runs.append([])
        runs = [r for r in runs if r]
        same: list[bool] = []
        none = np.zeros(0, np.int64)
        made: list[list[tuple[np.ndarray, np.ndarray]]] = [[(none, none)], [(none, none)]]
        joined = [" ".join(r) for r in runs]
        for run, *sides in zip(runs, *(side.encode(joined) for side in self._sides)):
            whole = self._given_back(" ".join(run), sides)
            for part in [run] if whole else [[s] for s in run]:
                ids = sides if whole else [side.encode(part)[0] for side in self._sides]
                good = whole or self._given_back(part[0], ids)
                ends = np.cumsum([len(s.encode()) + 1 for s in part])
                same += [good] * len(part)
                for k, i in enumerate(ids):
                    i = np.array(i if good else [], np.int64)
                    n = np.bincount(np.searchsorted(ends, np.cumsum(self._bytes[k][i])), minlength=len(part))
                    made[k].append((i, n))
        return [(np.concatenate([i for i, _ in m]), np.concatenate([n for _, n in m])) for m in made], np.array(same, bool)

    def _given_back(self, text: str, ids: list[list[int]]) -> bool:
        whole = (" " + text).encode()
        return all(b"".join(map(side.tokens.__getitem__, i)) == whole for side, i in zip(self._sides, ids))

    def _coalesce(self, segments: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[str], np.ndarray]:
        """Of each segment: whether it is given back; numbers of A, of B, of groups and of links; the groups as
        text; and all links as codes, segment by segment."""
        ((a, n_a), (b, n_b)), same = self._encode(segments)
        count = len(segments)
        side = np.repeat(np.array([0, 1], np.int64), [len(a), len(b)])
        ids = np.concatenate([a, b])
        length = np.concatenate([self._bytes[0][a], self._bytes[1][b]])
        # both sides cover the same bytes in a row, so that a running sum places every token of the batch
        end = np.concatenate([np.cumsum(length[:len(a)]), np.cumsum(length[len(a):])])
        start = end - length
        owner = np.concatenate([np.repeat(np.arange(count), n_a), np.repeat(np.arange(count), n_b)])

        order = np.lexsort((side, start))
        start, end, side, ids, owner = (x[order] for x in (start, end, side, ids, owner))
        reach = np.maximum.accumulate(end)
        first = np.ones(len(ids), bool)
        first[1:] = start[1:] >= reach[:-1]
        group = np.cumsum(first)

        # each stretch from one start to the next is covered by the last token of either side
        last = np.ones(len(ids), bool)
        last[:-1] = start[1:] > start[:-1]
        link_a = ids[side == 0][np.cumsum(side == 0)[last] - 1]
        link_b = ids[side == 1][np.cumsum(side == 1)[last] - 1]

        # A's tokens of a group, then B's
        grouped = np.argsort(group * 2 + side, kind="stable")
        key = (group * 2 + side)[grouped]
        closes = np.ones(len(key), bool)
        closes[:-1] = key[1:] != key[:-1]
        text, lengths = self._numerals.write(ids[grouped], np.where(closes, 1 + side[grouped], 0))
        ends = np.cumsum(np.bincount(owner[grouped], weights=lengths, minlength=count).astype(np.int64)).tolist()
        groups = [text[lo:max(hi - 1, lo)].decode() for lo, hi in zip([0, *ends], ends)]
        numbers = [n_a, n_b, np.bincount(owner[first], minlength=count), np.bincount(owner[last], minlength=count)]
        return same, numbers, groups, link_a * self.sizes[1] + link_b

    def align(self, texts: list[str]) -> dict[str, list]:
        """Per text: n_a, n_b, n_groups, n_links, the groups as text, linked pairs (codes) and how often each.

        Each distinct segment of the batch is encoded and aligned once.
        """
        segments, rows, bounds = self._segments(texts)
        same, numbers, texts_of, links = self._coalesce(segments)
        docs = len(texts)
        doc = np.repeat(np.arange(docs), np.diff(bounds))
        broken = np.bincount(doc[~same[rows]], minlength=docs) > 0
        used = ~broken[doc]
        out: dict[str, list] = {
            name: np.bincount(doc[used], weights=n[rows[used]], minlength=docs).astype(np.int64).tolist()
            for name, n in zip(("n_a", "n_b", "n_groups", "n_links"), numbers)}
        out["groups"] = ["" if bad else ";".join(map(texts_of.__getitem__, rows[lo:hi].tolist()))
                         for bad, lo, hi in zip(broken, bounds[:-1].tolist(), bounds[1:].tolist())]

        # the distinct segments of each text, then their links, then the distinct pairs
        found, times = np.unique(doc[used] * max(len(segments), 1) + rows[used], return_counts=True)
        of_doc, segment = np.divmod(found, max(len(segments), 1))
        n = numbers[3][segment]
        begin = (np.cumsum(numbers[3]) - numbers[3])[segment]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        space = self.sizes[0] * self.sizes[1]
        key = np.repeat(of_doc, n) * space + links[at]
        order = np.argsort(key)
        key, times = key[order], np.repeat(times, n)[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[new], np.add.reduceat(times, new) if len(new) else times
        places = np.searchsorted(key, np.arange(docs + 1) * space).tolist()
        codes, times = (key % space).astype(_code_type(space)), times.astype("<u4")
        out["pairs"] = [codes[lo:hi].tobytes() for lo, hi in zip(places, places[1:])]
        out["times"] = [times[lo:hi].tobytes() for lo, hi in zip(places, places[1:])]
        return out


def _segments(text: str) -> list[str]:
    """`text` without the blanks at which segments begin; each segment stands for a blank and itself."""
    parts = text.split(" ")
    if not _INNER_BLANK.search(text):
        return parts
    out = parts[:1]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    if len(out) > 1 and not out[-1]:  # an empty segment would lose its blank
        out[-2:] = [out[-2] + " "]
    return out


def _code_type(space: int) -> str:
    return "<u8" if space >> 32 else "<u4"


_loaded: dict[TokenizerPair, Aligner] = {}


def aligner(pair: TokenizerPair) -> Aligner:
    """One aligner a worker and pair of files."""
    if pair not in _loaded:
        _loaded[pair] = Aligner(pair)
    return _loaded[pair]


ALIGNED = ("doc_id long, chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "pairs binary, times binary")


def align(docs: DataFrame, pair: TokenizerPair, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the tokens of both sides, grouped and linked.

    `groups` is `a1,a2|b1;a3|b2,b3`: decimal ids of A and of B, in order. `pairs` holds the distinct linked
    pairs of the document as codes a * (size of B) + b, ascending, unsigned little-endian; `times` how often each
    is linked. `chunk` numbers rows of one input partition whose texts add up to about CHUNK_BYTES.

    Defined cases: a text that is null, empty, or that a tokenizer does not give back byte by byte (say, with a
    letter U+2581) has no tokens: zeros, empty groups and pairs. Each of several rows with one id, and rows without
    id, stand alone. Other columns are ignored. Whole texts are read, long ones in parts that end where both
    tokenizers start afresh. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, done = aligner(pair), 0
        base = TaskContext.get().partitionId() << 32
        for f in frames:
            ids, texts = f.column("doc_id"), f.column("text").to_pylist()
            sizes = [len(t) for t in texts]
            for part in batches(texts, sizes, 1 << 19):
                made = worker.align(texts[part.start:part.stop])
                before = done + np.concatenate([[0], np.cumsum(np.array(sizes[part.start:part.stop]) + _ROW_BYTES)])
                done = int(before[-1])
                made["doc_id"] = ids.slice(part.start, len(part))
                made["chunk"] = pa.array(base + before[:-1] // CHUNK_BYTES)
                yield pa.RecordBatch.from_pydict({n.split()[0]: made[n.split()[0]] for n in ALIGNED.split(", ")})

    return rows.mapInArrow(run, ALIGNED)


def _pairs_of_chunks(aligned: DataFrame, space: int) -> DataFrame:
    """(chunk, pair, n_docs): distinct pairs of each chunk, counted before anything is shuffled."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(chunk: int, held: list[bytes]) -> pa.RecordBatch:
            pairs, n = np.unique(np.frombuffer(b"".join(held), _code_type(space)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(pairs.astype(np.int64)),
                                               pa.array(n.astype(np.int64))], ["chunk", "pair", "n_docs"])

        chunk, held = None, []
        for f in frames:
            for c, p in zip(f.column("chunk").to_pylist(), f.column("pairs").to_pylist()):
                if c != chunk and held:
                    yield counted(chunk, held)
                    held = []
                chunk = c
                held.append(p)
        if held:
            yield counted(chunk, held)

    return aligned.select("chunk", "pairs").mapInArrow(run, "chunk long, pair long, n_docs long")


def _totals(chunks: DataFrame, size_b: int) -> DataFrame:
    totals = chunks.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    a = F.floor(F.col("pair") / size_b)
    # at most one row an id of A's vocabulary: its size bounds the broadcast
    best = totals.groupBy(a.alias("a")).agg(F.max("n_docs").alias("most"))
    return totals.withColumn("a", a).join(F.broadcast(best), "a").select(
        "pair", "a", (F.col("pair") % size_b).alias("b"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def sizes_of(pair: TokenizerPair) -> tuple[int, int]:
    a, b = aligner(pair).sizes
    return a, b


def pair_counts(aligned: DataFrame, pair: TokenizerPair) -> DataFrame:
    """(a, b, n_docs, best): in how many rows of `align` ids a and b are linked; best: none of a's pairs has more."""
    size_a, size_b = sizes_of(pair)
    return _totals(_pairs_of_chunks(aligned, size_a * size_b), size_b).select("a", "b", "n_docs", "best")


def judge_links(aligned: DataFrame, pair: TokenizerPair) -> DataFrame:
    """The rows of `align` without pairs and times, with n_best and count_sum.

    n_best: links whose pair's count is the highest of its id of A, ties included; count_sum: the counts of all
    links added up. Counts go back to the chunks whose pairs they are, each once a chunk, so what is shuffled
    is the distinct pairs of chunks and never the links. `aligned` is read three times: pass a written table.
    """
    size_a, size_b = sizes_of(pair)
    space = size_a * size_b
    chunks = _pairs_of_chunks(aligned, space)
    known = chunks.select("chunk", "pair").join(_totals(chunks, size_b).select("pair", "n_docs", "best"), "pair")
    kept = [c for c in aligned.columns if c not in ("chunk", "pairs", "times")]
    schema = aligned.select(*kept, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).schema

    def judged(docs: pa.Table, counts: pa.Table) -> pa.Table:
        # a chunk whose rows were read in two splits has its pairs twice, with equal counts
        codes, at = np.unique(counts.column("pair").to_numpy(), return_index=True)
        n = counts.column("n_docs").to_numpy()[at]
        best = counts.column("best").to_numpy()[at]
        n_best, count_sum = [], []
        for p, t in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist()):
            times = np.frombuffer(t, "<u4").astype(np.int64)
            k = np.searchsorted(codes, np.frombuffer(p, _code_type(space)).astype(np.int64))
            n_best.append(int(times[best[k]].sum()))
            count_sum.append(int((times * n[k]).sum()))
        return (docs.select(kept).append_column("n_best", pa.array(n_best, pa.int64()))
                .append_column("count_sum", pa.array(count_sum, pa.int64())))

    return aligned.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(judged, schema)


def align_and_judge(docs: DataFrame, pair: TokenizerPair, *, id_col: str = "doc_id", text_col: str = "text",
                    **more) -> DataFrame:
    """`align`, written once with columns `more` made from it in place of `groups`, then `judge_links`."""
    aligned = align(docs, pair, id_col=id_col, text_col=text_col)
    return judge_links(cut(aligned.withColumns(more).drop("groups") if more else aligned), pair)
