"""Benchmark decontamination: passages of test items found in training documents, and taken out.

The windows of all items (n words in a row, or a whole shorter item) go to every task as a set of hashes,
as long as they are few. Documents are scanned word by word; a window whose hash is in the set is compared
with the item's words, and all its words are hit. Where the windows are too many to send, those of the
documents that pass a filter of fixed size meet them in a join.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from burstline.lineage import cut
from burstline.llm.hashing import batches, hashes_of_spans, lower_ascii, mixed
from burstline.llm.text import text_or_empty

N = 10
# a set of so many windows at most is sent to every task, each with its words
MAX_BROADCAST = 200_000
# bits of the filter that takes the place of the set beyond that: 16 MB
_FILTER_BITS = 27
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, np.int8)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


class Words:
    """The words of a batch of texts: where they are in the joined, lower-cased bytes, and their hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
        edge = np.flatnonzero(np.diff(_IN_WORD[self.data], prepend=np.int8(0)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        # the words of text i are bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, self.begins)
        self.hashes = hashes_of_spans(self.data, self.starts, self.ends)

    def windows(self, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words, hashes) of all windows of each size that lie in one text."""
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.starts))
        out = np.zeros(len(self.starts), np.uint64)
        for k in range(max(sizes, default=0)):
            out = mixed(out[:len(self.hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[k:])
            if k + 1 in sizes:
                at = np.flatnonzero(left[:len(out)] > k)
                yield k + 1, at, mixed(out[at] + np.uint64(k))

    def window(self, first: int, size: int) -> bytes:
        """The words of a window, with single blanks."""
        return b" ".join(_WORD.findall(self.data[self.starts[first]:self.ends[first + size - 1]].tobytes()))


def item_windows(benchmark: DataFrame, *, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window, size): the distinct windows of each item, as words with single blanks.

    A window is n words in a row; an item of fewer words, but not none, is one window; null has none.
    """
    lower = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    size = F.least(F.size("words"), F.lit(n))
    return (benchmark.select(F.col(id_col).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
            .select("item_id", size.alias("size"),
                    F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1),
                                          lambda i: F.array_join(F.slice("words", i, size), " "))).alias("window"))
            .distinct())


def _hashes_of(windows: list[bytes]) -> np.ndarray:
    """Hashes of item windows, equal to those of `Words.windows`."""
    out = np.empty(len(windows), np.uint64)
    words = Words(windows)
    size_of = np.diff(words.bounds)
    for size, at, hashes in words.windows(sorted(set(size_of.tolist()))):
        text = np.searchsorted(words.bounds, at, side="right") - 1
        whole = size_of[text] == size
        out[text[whole]] = hashes[whole]
    return out


class WindowSet:
    """Windows of all items, by hash: sent to every task."""

    def __init__(self, windows: list[tuple[bytes, int]]) -> None:
        """`windows`: (words, number of the window)."""
        hashes = _hashes_of([w for w, _ in windows])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.words = [windows[k][0] for k in order]
        self.numbers = [windows[k][1] for k in order]
        self.sizes = sorted({w.count(b" ") + 1 for w in self.words})
        self._near = np.zeros(1 << 20, bool)
        self._near[self.hashes >> np.uint64(44)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, size, number of the window) of every occurrence, verified word by word."""
        for size, at, hashes in words.windows(self.sizes):
            near = np.flatnonzero(self._near[hashes >> np.uint64(44)])
            at, hashes = at[near], hashes[near]
            lo, hi = (np.searchsorted(self.hashes, hashes, side=s) for s in ("left", "right"))
            for first, a, b in zip(*(x[hi > lo].tolist() for x in (at, lo, hi))):
                text = words.window(first, size)
                for k in range(a, b):
                    if self.words[k] == text:
                        yield first, size, self.numbers[k]


Window = tuple[int, int, int, int, object]


def _found(texts: list[str], hits_of: Callable[[Words], Iterator[tuple[int, int, object]]]) -> tuple[list[int], list[list[Window]]]:
    """Per text: number of words, and windows found (first word, words, place and end in code points, what)."""
    raw = [t.encode() for t in texts]
    words = Words(raw)
    out: list[list[Window]] = [[] for _ in texts]
    hits = list(hits_of(words))
    if hits:
        first, size, what = zip(*hits)
        first, size = np.array(first), np.array(size)
        starts, ends = words.starts[first], words.ends[first + size - 1]
        points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # bytes to code points
        text = np.searchsorted(words.bounds, first, side="right") - 1
        begin = points[words.begins[text]]
        for t, *w in zip(text.tolist(), (first - words.bounds[text]).tolist(), size.tolist(),
                         (points[starts] - begin).tolist(), (points[ends] - begin).tolist(), what):
            out[t].append(tuple(w))
    return np.diff(words.bounds).tolist(), out


def _merged(windows: list[Window]) -> tuple[int, list[int]]:
    """Number of words inside the windows, and the runs they form: start and end in code points, in turn."""
    hit, until, runs = 0, -1, []
    for first, size, start, end, *_ in sorted(w[:4] for w in windows):
        hit += max(first + size - max(first, until), 0)
        if first > until:
            runs += [start, end]
        elif first + size > until:
            runs[-1] = end
        until = max(until, first + size)
    return hit, runs


def _broadcast(rows: DataFrame, windows: list[tuple[str, list[str]]]) -> DataFrame:
    """(doc, n_words, n_hit, runs, items) of rows (doc, text), all windows known to every task."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(windows)
    made: list[WindowSet] = []
    schema = rows.select("doc", F.expr("0L AS n_words"), F.expr("0L AS n_hit"), F.expr("array(0L) AS runs"),
                         F.expr("array('') AS items")).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(WindowSet([(w.encode(), k) for k, (w, _) in enumerate(known.value)]))
        items_of = [i for _, i in known.value]
        for f in frames:
            texts = f.column("text").to_pylist()
            for part in batches(texts, [len(t) + 64 for t in texts], 1 << 20):
                n_words, found = _found(texts[part.start:part.stop], made[0].hits)
                merged = [_merged(w) for w in found]
                items = [sorted(set(itertools.chain.from_iterable(items_of[k] for k in {w[4] for w in ws}))) for ws in found]
                yield pa.RecordBatch.from_arrays(
                    [f.column("doc").slice(part.start, len(part)), pa.array(n_words, pa.int64()),
                     pa.array([m[0] for m in merged], pa.int64()), pa.array([m[1] for m in merged], pa.list_(pa.int64())),
                     pa.array(items, pa.list_(pa.string()))], ["doc", "n_words", "n_hit", "runs", "items"])

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """The same by a join of windows (item_id, window, size), for any number of them.

    Each task has a filter of fixed size; windows of documents that pass it go on with their words, by which
    they join. Rows go to a written table in between, under a number of their own.
    """
    spark = rows.sparkSession

    def hashed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            bits = _hashes_of([w.encode() for w in f.column("window").to_pylist()]) >> np.uint64(64 - _FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)),
                                              pa.array((bits & np.uint64(63)).astype(np.int32))], ["word", "bit"])

    marked = (windows.select("window").mapInArrow(hashed, "word long, bit int").distinct()
              .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow())
    filled = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    filled[marked.column("word").to_numpy()] = marked.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(filled)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    schema = rows.select(F.expr("0L AS number"), "doc", F.expr("0L AS n_words"), F.expr(
        "array(named_struct('first', 0L, 'size', 0L, 'start', 0L, 'end', 0L, 'window', '')) AS found")).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing(words: Words) -> Iterator[tuple[int, int, str]]:
            for size, at, hashes in words.windows(sizes):
                bits = hashes >> np.uint64(64 - _FILTER_BITS)
                set_ = (sent.value[bits >> np.uint64(6)] >> (bits & np.uint64(63)).astype(np.int64)) & 1
                for first in at[set_ > 0].tolist():
                    yield first, size, words.window(first, size).decode()

        number = TaskContext.get().partitionId() << 40
        for f in frames:
            texts = f.column("text").to_pylist()
            for part in batches(texts, [len(t) + 64 for t in texts], 1 << 20):
                n_words, found = _found(texts[part.start:part.stop], passing)
                yield pa.RecordBatch.from_pydict(
                    {"number": pa.array(range(number, number + len(part)), pa.int64()),
                     "doc": f.column("doc").slice(part.start, len(part)), "n_words": pa.array(n_words, pa.int64()),
                     "found": [[dict(zip(("first", "size", "start", "end", "window"), w)) for w in ws] for ws in found]},
                    schema=to_arrow_schema(schema))
                number += len(part)

    scanned = cut(rows.mapInArrow(run, schema))
    each = scanned.select("number", F.explode("found").alias("w"))
    # every window is joined once, whatever number of items has it
    met = (each.join(windows.groupBy(F.col("window").alias("words")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items")),
                     F.col("w.window") == F.col("words"))
           .groupBy("number").agg(F.collect_set(F.struct("w.first", "w.size", "w.start", "w.end")).alias("hits"),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))

    @F.pandas_udf("n_hit long, runs array<long>")
    def merged(hits: pd.Series) -> pd.DataFrame:
        made = [_merged([tuple(w[c] for c in ("first", "size", "start", "end")) for w in ws]) for ws in hits]
        return pd.DataFrame(made, columns=["n_hit", "runs"])

    met = met.select("number", merged("hits").alias("m"), "items")
    return scanned.join(met, "number", "left").select(
        "doc", "n_words", F.coalesce("m.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("m.runs", F.expr("CAST(array() AS array<long>)")).alias("runs"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def _judged(rows: DataFrame, benchmark: DataFrame, n: int, item_col: str, item_text_col: str, max_broadcast: int) -> DataFrame:
    windows = cut(item_windows(benchmark, n=n, id_col=item_col, text_col=item_text_col))
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("window") + 64), F.lit(0))).first()
    if count > max_broadcast or size > 256 * max_broadcast:
        return _joined(rows, windows)
    items = F.collect_set(F.col("item_id").cast("string"))
    return _broadcast(rows, [tuple(r) for r in windows.groupBy("window").agg(items).collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = N, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, spans, items.

    Words are runs of a-z, 0-9 and all letters beyond ASCII, A-Z lower-cased. n_hit counts the words inside any
    occurrence of an item's window (`item_windows`); `spans` are the runs they form, (start, end) in code points;
    `items` the ids of the items with occurring windows, as strings, sorted and distinct.

    Defined cases: null and empty texts have no words; an item without words has no window; an item without id
    marks words but is not listed; several rows of one item are one item; each of several rows with one id, and
    rows without id, stand alone; other columns are ignored; an empty benchmark marks nothing, and no documents
    give no rows. Up to `max_broadcast` windows of 256 bytes on average go to every task, more are joined.
    """
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("doc"), text_or_empty(text_col).alias("text"))
    judged = _judged(rows, benchmark, n, item_col, item_text_col, max_broadcast)
    return judged.select("doc.doc_id", "n_words", "n_hit", _spans().alias("spans"), "items")


def _spans() -> Column:
    return F.expr(
        "CASE WHEN size(runs) > 0 THEN transform(sequence(0, size(runs) - 2, 2), "
        "i -> named_struct('start', runs[i], 'end', runs[i + 1])) "
        "ELSE CAST(array() AS array<struct<start: long, end: long>>) END")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, whole: bool = False, n: int = N, text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`docs` with all its columns, without the rows that hold a window (`whole`) or without the marked spans.

    A span goes from the start of its first word to the end of its last one; what stands around it stays as it is.
    Cases as in `contamination`; null texts stay null.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text_or_empty(text_col).alias("text"))
    judged = _judged(rows, benchmark, n, item_col, item_text_col, max_broadcast)
    if whole:
        return judged.where("n_hit = 0").select("doc.*")

    @F.pandas_udf("string")
    def without(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else "".join(t[a:b] for a, b in zip([0, *r[1::2]], [*r[::2], len(t)]))
                          for t, r in zip(text, runs)], dtype=object)

    text = without(f"doc.{text_col}", "runs")
    return judged.select(*[text.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])
