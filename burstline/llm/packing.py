"""Packing documents into sequences by lexical retrieval.

A document fills as many whole windows as it can by itself; what is left of it, its tail, is packed with
tails that resemble it. Tails are dealt to shards by their rarest token, so that those with a rare token in
common meet. Each shard, a bounded block of tails, is an inverted index of BM25 weights, with token
frequencies and lengths counted over all tails. The first unused tail seeds a window; its weightiest
tokens are looked up, and the best unused neighbours are put in as long as they fit, lookup after lookup. If the
window still has room, the best one that did not fit is cut to fill it, and what remains of that one stays in the
index. Without neighbours, the next unused tail goes in.

So every window is full but the last of a partition, which is cut into powers of two: no token is padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.hashing import batches
from burstline.llm.text import text_or_empty
from burstline.llm.tokens import tokenizer, unload
from burstline.llm.workers import text_batches, tidy

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_tokens long")
# sequences of packed tails are numbered from here, those of single documents from 0
_PACKED = 1 << 62
# bytes of texts that are tokenised together
_BATCH = 1 << 20


@dataclass(frozen=True)
class PackParams:
    window: int = 2048
    end_id: int = 1  # stands behind each document
    query_tokens: int = 12  # of a seed, looked up in the index
    neighbours: int = 64  # of a seed that are offered before the next lookup
    shard: int = 4096  # tails in an index
    k1: float = 1.2
    b: float = 0.75


def _tokenized(docs: DataFrame, path: str, params: PackParams) -> DataFrame:
    """(doc_id, doc_tokens, first, crcs, tail): whole windows by number and checksum, and the ids of the tail."""
    size, short = params.window, short_ids(tokenizer(path).size)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokenizer(path), np.array([params.end_id], "<u4")
        number = TaskContext.get().partitionId() << 33
        for f in frames:
            texts = f.column("text")
            for part in batches(texts, (pc.binary_length(texts).to_numpy() + 64).tolist(), _BATCH):
                ids, bounds = words.encode(texts.slice(part.start, len(part)).to_pylist())
                tokens, first, crcs, tails = [], [], [], []
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    whole, text = (hi - lo + 1) // size, np.concatenate([ids[lo:hi], end])
                    tokens.append(len(text))
                    first.append(number)
                    number += whole
                    crcs.append([zlib.crc32(text[i * size:(i + 1) * size]) for i in range(whole)])
                    tails.append(text[whole * size:].astype("<u2" if short else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [f.column("doc_id").slice(part.start, len(part)), pa.array(tokens, pa.int64()), pa.array(first, pa.int64()),
                     pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                    ["doc_id", "doc_tokens", "first", "crcs", "tail"])

    return docs.mapInArrow(tidy(run), "doc_id long, doc_tokens long, first long, crcs array<long>, tail binary")


def short_ids(size: int) -> bool:
    """Whether the ids of a vocabulary fit in 16 bits."""
    return size <= 1 << 16


def _ids(tail: bytes, short: bool) -> np.ndarray:
    return np.frombuffer(tail, "<u2" if short else "<u4")


def _statistics(tails: DataFrame, size: int, path: str) -> tuple[np.ndarray, float]:
    """How many tails hold each token, and their mean length. One number a token of the vocabulary."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload(path)  # kept from task to task until here: the workers that tokenised go on with this
        short, df = short_ids(size), np.zeros(size + 2, np.int64)
        for f in frames:
            tails = f.column("tail").to_pylist()
            for lo in range(0, len(tails), 256):
                part = [_ids(t, short) for t in tails[lo:lo + 256]]
                lengths = [len(t) for t in part]
                owner = np.repeat(np.arange(len(part)) * size, lengths)
                df[:size] += np.bincount(np.unique(owner + np.concatenate(part)) % size, minlength=size)
                df[-1] += sum(lengths)
                df[-2] += len(part)
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["token", "df"])

    counted = tails.mapInArrow(tidy(run), "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size + 2, np.int64)
    df[counted.column("token").to_numpy()] = counted.column("df").to_numpy()
    return df, float(df[-1]) / max(1.0, float(df[-2]))


class Shard:
    """A BM25 index over a block of tails, of which parts get used up."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, params: PackParams) -> None:
        self.tails, self.params = tails, params
        self.used = np.zeros(len(tails), np.int64)  # tokens taken from the front
        self.length = np.array([len(t) for t in tails], np.int64)
        self.next = 0
        tokens, weights = [], []
        for t in tails:
            u, tf = np.unique(t, return_counts=True)
            tokens.append(u.astype(np.int64))
            weights.append((idf[u] * tf * (params.k1 + 1) / (
                tf + params.k1 * (1 - params.b + params.b * len(t) / mean))).astype(np.float32))
        self._tokens, self._weights = tokens, weights
        every = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(tails)), [len(u) for u in tokens])
        self._posted, self._posted_weight = owner[order], (np.concatenate(weights) if weights else every)[order]
        self._listed, begins = np.unique(every[order], return_index=True)
        self._begins = np.append(begins, len(every))

    def left(self, i: int) -> int:
        return int(self.length[i] - self.used[i])

    def seed(self) -> int | None:
        """The first tail with tokens left."""
        while self.next < len(self.tails) and not self.left(self.next):
            self.next += 1
        return self.next if self.next < len(self.tails) else None

    def neighbours(self, i: int) -> list[int]:
        """Tails with tokens left that share weighty tokens with tail i, best first."""
        k = min(self.params.query_tokens, len(self._weights[i]))
        query = self._tokens[i][np.argpartition(-self._weights[i], k - 1)[:k]]
        score = np.zeros(len(self.tails), np.float32)
        for at in np.searchsorted(self._listed, query):
            lo, hi = self._begins[at], self._begins[at + 1]
            score[self._posted[lo:hi]] += self._posted_weight[lo:hi]
        score[self.used >= self.length] = 0
        score[i] = 0
        found = np.flatnonzero(score)
        if len(found) > self.params.neighbours:
            found = found[np.argpartition(-score[found], self.params.neighbours)[:self.params.neighbours]]
        return found[np.lexsort((found, -score[found]))].tolist()

    def take(self, i: int, room: int) -> tuple[int, int, int]:
        """Up to `room` tokens of tail i: (i, start in the tail, length)."""
        n, start = min(room, self.left(i)), int(self.used[i])
        self.used[i] += n
        return i, start, n

    def window(self) -> list[tuple[int, int, int]] | None:
        """Pieces of the next window; None when fewer tokens than a window are left, with the pieces in `rest`."""
        if int((self.length - self.used).sum()) < self.params.window:
            return None
        first = self.seed()
        pieces = [self.take(first, self.params.window)]
        room = self.params.window - pieces[0][2]
        while room and (waiting := self.neighbours(first)):
            too_long = [i for i in waiting if self.left(i) > room]
            for i in waiting:
                if 0 < self.left(i) <= room:
                    pieces.append(self.take(i, room))
                    room -= pieces[-1][2]
            if room and too_long:  # cut to fill the window; else all offered ones are used up, and others are looked up
                pieces.append(self.take(too_long[0], room))
                room = 0
        while room:
            pieces.append(self.take(self.seed(), room))
            room -= pieces[-1][2]
        return pieces


def _packed(frames: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, short: bool, params: PackParams):
    """Pieces of the tails of a partition, shard by shard."""
    number = _PACKED | (TaskContext.get().partitionId() << 33)
    held: list[tuple] = []  # (doc_id, doc_tokens, tokens before the tail, ids)

    def rows(pieces: list[tuple], size: int) -> list[tuple]:
        nonlocal number
        offset, out = 0, []
        for doc, tokens, before, ids in pieces:
            out.append((doc, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, number, offset, size))
            offset += len(ids)
        number += 1
        return out

    def shard(block: list[tuple]) -> Iterator[list[tuple]]:
        nonlocal held
        index = Shard([b[3] for b in block], idf, mean, params)

        def piece(i: int, start: int, n: int) -> tuple:
            doc, tokens, before, ids = block[i]
            return doc, tokens, before + start, ids[start:start + n]

        while (window := index.window()) is not None:
            yield rows([piece(*p) for p in window], params.window)
        held = [piece(i, int(index.used[i]), index.left(i)) for i in range(len(block)) if index.left(i)]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    for f in frames:
        held += [(d, n, n - len(ids), ids) for d, n, ids in zip(
            f.column("doc_id").to_pylist(), f.column("doc_tokens").to_pylist(),
            (_ids(t, short) for t in f.column("tail").to_pylist()))]
        while len(held) >= params.shard:
            block, waiting = held[:params.shard], held[params.shard:]
            out = [r for w in shard(block) for r in w]
            held += waiting
            if out:
                yield batch(out)
    out = [r for w in shard(held) for r in w]
    room, sequence, rest = 0, [], list(held)  # less than a window: sequences of powers of two
    while rest:
        if not room:
            room = size = 1 << (sum(len(p[3]) for p in rest).bit_length() - 1)
        doc, tokens, before, ids = rest.pop(0)
        sequence.append((doc, tokens, before, ids[:room]))
        if len(ids) > room:
            rest.insert(0, (doc, tokens, before + room, ids[room:]))
        room -= min(room, len(ids))
        if not room:
            out += rows(sequence, size)
            sequence = []
    if out:
        yield batch(out)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit numbers), doc_tokens (ids of its document, end id included), sequence_id,
    offset (place in the sequence, without gaps) and sequence_tokens.

    Each id of each row lies in exactly one piece. Sequences hold `window` ids, or a power of two.

    Defined cases: a null or empty text is its end id alone; null ids stay null; repeated rows are packed
    each; other columns are ignored; an empty table gives no pieces.
    """
    if params.window & (params.window - 1):
        raise ValueError("the window must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    with text_batches(docs.sparkSession):
        made = cut(_tokenized(rows, tokenizer_path, params))
    single = made.select("doc_id", "doc_tokens", "first", F.posexplode("crcs").alias("i", "crc")).select(
        "doc_id", (F.col("i").cast("long") * params.window).alias("start"), F.lit(params.window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(params.window).cast("long").alias("sequence_tokens"))
    tails = made.where(F.length("tail") > 0).select("doc_id", "doc_tokens", "tail")
    size = tokenizer(tokenizer_path).size
    df, mean = _statistics(tails, size, tokenizer_path)
    n, df = max(1, int(df[-2])), df[:-2]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    idf[df < 2] = 0  # no other tail has it
    shared = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def routed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, rare = short_ids(size), shared.value
        for f in frames:
            ids = [_ids(t, short) for t in f.column("tail").to_pylist()]
            yield f.append_column("route", pa.array([int(t[np.argmax(rare[t])]) for t in ids], pa.int32()))

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(frames, shared.value, mean, short_ids(size), params)

    # a token that a third of all tails have as their rarest would make one partition: it is split by size
    spread = (tails.mapInArrow(tidy(routed), "doc_id long, doc_tokens long, tail binary, route int").hint("rebalance", "route")
              .sortWithinPartitions("route", "doc_tokens", "doc_id", F.xxhash64("tail")))
    return single.unionByName(spread.mapInArrow(tidy(packed), _PIECES))
