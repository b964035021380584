"""Document fingerprints: bottom-k sketches of shingle hashes.

The sketch of a text is the k smallest hashes of its distinct shingles, each kept to 40 bits, with a
count of distinct shingles that is exact while they fit and estimated from the k-th hash beyond. Sketches
of parts merge into the sketch of the whole, and two sketches give the resemblance (Jaccard) of the
texts, the containment of one in the other, and the number of distinct shingles.

As text, a fingerprint is base64 of 5 bytes a hash, in ascending order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.hashing import batches, mixed, shingles_of, words_of
from burstline.llm.text import text_or_empty

K = 128
SHINGLE = 5
_BITS = 40
_ALL = float(1 << _BITS)


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct 40-bit hashes, ascending."""
    return np.unique(mixed(shingles) >> np.uint64(64 - _BITS))[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def distinct_shingles(s: np.ndarray, k: int = K) -> float:
    """Exact below k hashes, else estimated from the k-th."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / _ALL)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the hashes of the merged sketch that both have; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = merged(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of a that b has too, among the hashes of a that b's sketch would hold."""
    if not len(a):
        return 1.0
    seen = a if len(b) < k else a[a <= b[-1]]
    return float(np.isin(seen, b, assume_unique=True).sum() / len(seen)) if len(seen) else 0.0


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def sketches_of(texts: list[str], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    raw = [t.encode() for t in texts]
    for part in batches(raw, [len(t) for t in raw]):
        out += [sketch(s, k) for s in shingles_of(*words_of([raw[i] for i in part]), shingle)]
    return out


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                shingle: int = SHINGLE) -> DataFrame:
    """One row per row: doc_id, n_chars, fingerprint, distinct_shingles. Null texts are empty: fingerprint ''."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("fingerprint"),
                         F.lit(0.0).alias("distinct_shingles")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = sketches_of(list(f["text"]), k, shingle)
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_chars": [len(t) for t in f["text"]],
                                "fingerprint": [to_text(s) for s in made],
                                "distinct_shingles": [distinct_shingles(s, k) for s in made]})

    return rows.mapInPandas(run, schema)


def ring_heads(rows: DataFrame, rows_per_bucket: int) -> list[int]:
    """The ids that begin buckets of about so many rows, descending; at most 100,000 of them."""
    n = min(max(1, rows.count() // rows_per_bucket), 100_000)
    ids = rows.where("doc_id IS NOT NULL").select("doc_id").repartitionByRange(n, F.desc("doc_id"))
    heads = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("head"))
    return sorted((r["head"] for r in heads.collect()), reverse=True)


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                      shingle: int = SHINGLE, rows_per_bucket: int = 1000) -> DataFrame:
    """Fingerprints of each text, of the text edited with the start of the next one, and their likeness.

    Rows are in a ring of descending id (equal ids by text, null ids last; after the last comes the first).
    The edited text is the text whose last n // 2 code points are replaced by as many of the next text.
    Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    the estimate distinct_shingles.

    Defined cases: null texts are empty, and two empty texts are alike; one row is its own next; where no
    row has an id, the last row is its own next; other columns are ignored; an empty table gives no rows.

    The ring is cut at ids into buckets of bounded size; the rows that begin a bucket go along with the
    bucket before it as well, so each text is shuffled once and buckets are read as a stream.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    heads = ring_heads(rows, rows_per_bucket)
    last = max(len(heads) - 1, 0)
    down = -np.array(heads, np.int64)

    def dealt(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(f: pa.RecordBatch, bucket: np.ndarray, extra: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [f.column("doc_id"), f.column("text"), pa.array(bucket), pa.array(np.full(len(f), extra))],
                ["doc_id", "text", "bucket", "extra"])

        for f in frames:
            null = f.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = f.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            at = np.where(null, last, np.searchsorted(down, -ids, side="right") - 1)
            yield batch(f, at, False)
            begins = ~null & (ids == -down[at]) if len(down) else null & False
            if begins.any():
                at = at[begins]
                yield batch(f.filter(pa.array(begins)), np.where(at > 0, at - 1, last), True)

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, distinct_shingles double")

    def compared(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose next row is not known yet
        for f in frames:
            queue = held + list(zip(*(f.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))))
            pairs = [(a, b) for a, b in zip(queue, queue[1:]) if not a[1] and a[0] == b[0]]
            held = queue[-1:]
            if pairs:
                yield judged(pairs)
        if held and not held[0][1]:
            yield judged([(held[0], held[0])])

    def judged(pairs: list[tuple]) -> pa.RecordBatch:
        texts, nexts = [a[3] for a, _ in pairs], [b[3] for _, b in pairs]
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, nexts)]
        # most rows are the next of the row before: their sketch is made once
        own = sketches_of(texts, k, shingle)
        follows = [i + 1 < len(pairs) and pairs[i][1] is pairs[i + 1][0] for i in range(len(pairs))]
        apart = iter(sketches_of([n for n, f in zip(nexts, follows) if not f], k, shingle))
        after = [own[i + 1] if f else next(apart) for i, f in enumerate(follows)]
        changed = sketches_of(edited, k, shingle)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            "fingerprint": [to_text(s) for s in own], "edited_fingerprint": [to_text(s) for s in changed],
            "near_edited": [resemblance(a, b, k) for a, b in zip(own, changed)],
            "near_next": [resemblance(a, b, k) for a, b in zip(own, after)],
            "distinct_shingles": [distinct_shingles(s, k) for s in own]})

    spread = rows.mapInArrow(dealt, "doc_id long, text string, bucket long, extra boolean")
    return (spread.repartition("bucket")
            .sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")
            .mapInArrow(compared, schema))
