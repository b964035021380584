"""Hard-negative mining by a vertical scan (branch and bound on decomposed data).

Vectors of a cell lie column by column. For each anchor the columns are read in descending order of the
anchor's own magnitude there; what the columns still unread can add lies between sums of the column's
least and greatest value, and rows whose bounds rule them out leave the candidates. Rows that are left in
the end have exact scores.

A cell is a slice of all rows against a group of anchors, both of bounded size, dealt by an equi-join of
their numbers: every anchor meets every row, in blocks, and only the best few rows of each cell go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.lineage import cut

# columns that are read before bounds are taken again
_STEP = 8
# rows and anchors of a cell at most, about
_SLICE_ROWS, _GROUP_ANCHORS = 1 << 18, 1 << 16
# stands for a missing id, so that it comes last among ties
_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class MiningParams:
    # nearest rows of the anchor's label that count as its positives, and negatives returned for each
    positives: int = 5
    negatives: int = 3
    # a negative's score lies between these percentages of the positive's score
    low_percent: int = 50
    high_percent: int = 95


def integer_vectors(rows: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                    scale: int = 256) -> DataFrame:
    """(id, label, vector): components floor(scale * x), x as double, of the rows that can be compared.

    Rows with a null label, a null vector or any null or non-finite component are left out. Components beyond
    the range of long are set to its ends.
    """
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return (rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(vector_col, lambda x: F.floor(scale * x.cast("double"))).alias("vector")))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as columns: row d holds component d of every vector, zero beyond a vector's end."""
    lists = vectors.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).T
    out = np.zeros((width, len(lengths)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return out


def _width(*vectors: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for v in vectors for c in v.chunks), default=0)


class Cell:
    """All rows of a slice, column by column, in the narrowest type in which every sum is exact."""

    def __init__(self, rows: pa.Table, anchors: pa.Table) -> None:
        width = _width(rows.column("vector"), anchors.column("vector"))
        columns, self.anchors = _matrix(rows.column("vector"), width), _matrix(anchors.column("vector"), width).T
        most = sum(int(np.abs(a.astype(float)).max(initial=0)) * int(np.abs(x.astype(float)).max(initial=0))
                   for a, x in zip(self.anchors.T, columns))
        self._type = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 52 else object
        self.columns = np.ascontiguousarray(columns.astype(self._type))
        self.low, self.high = (f(axis=1) if columns.size else self.columns[:, :0].sum(axis=1)
                               for f in (self.columns.min, self.columns.max))
        self.ids, self.labels, self.row = (rows.column(c).to_numpy() for c in ("id", "label", "row"))

    def scan(self, anchor: np.ndarray, candidates: np.ndarray,
             keep: Callable[[np.ndarray, object, object], np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, exact scores) of the candidates that `keep` never ruled out.

        `keep` gets the sums so far and the least and most that the unread columns add; None keeps all.
        """
        order = np.argsort(-np.abs(anchor.astype(float)), kind="stable")
        weight = anchor[order].astype(self._type)
        ends = np.stack([weight * self.low[order], weight * self.high[order]])
        least, most = (np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0)))
        at = np.flatnonzero(candidates)
        total = np.zeros(len(at), self._type)
        for d in range(0, len(order), _STEP):
            if not len(at):
                break
            read = order[d:d + _STEP]
            part = self.columns[read] if len(at) == len(candidates) else self.columns[read[:, None], at]
            total = total + weight[d:d + _STEP] @ part
            if d + _STEP < len(order):
                kept = keep(total, least[d + _STEP], most[d + _STEP])
                if kept is not None and not kept.all():
                    at, total = at[kept], total[kept]
        return at, total

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k highest scores, ties by smaller id."""
        if len(at) > k:
            near = np.flatnonzero(scores >= _highest(scores, k))
        else:
            near = np.arange(len(at))
        return near[np.lexsort((self.ids[at[near]], -scores[near]))][:k]


def _highest(x: np.ndarray, k: int):
    """The k-th highest value."""
    return np.sort(x)[-k] if x.dtype == object else np.partition(x, -k)[-k]


def _long(x: np.ndarray) -> list[int]:
    return [max(-(1 << 63), min(int(v), (1 << 63) - 1)) for v in x]


def _nearest(cell: Cell, k: int):
    """Keeps rows whose upper bound reaches the k-th highest lower bound."""
    def keep(total: np.ndarray, least, most) -> np.ndarray | None:
        if len(total) <= k:
            return None
        return total >= _highest(total, k) - (most - least)

    return keep


def _in_windows(windows: list[tuple[int, int]], k: int):
    """Keeps rows that may be among the k highest scores of one of the windows [low, high]."""
    def keep(total: np.ndarray, least, most) -> np.ndarray:
        lower, upper = total + least, total + most
        kept = np.zeros(len(total), bool)
        for low, high in windows:
            sure = lower[(lower >= low) & (upper <= high)]
            reach = max(low, _highest(sure, k)) if len(sure) >= k else low
            kept |= (lower <= high) & (upper >= reach)
        return kept

    return keep


def _cells(rows: DataFrame, anchors: DataFrame, slices: int, groups: int, found: Callable, schema: str) -> DataFrame:
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select("row", "id", "label", "vector", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"),
                       every(groups).alias("group"))
    right = anchors.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("slice", every(slices))
    return left.groupBy("slice", "group").cogroup(right.groupBy("slice", "group")).applyInArrow(found, schema)


def mine(vectors: DataFrame, *, is_anchor: Column, params: MiningParams = MiningParams(),
         slice_rows: int = _SLICE_ROWS, group_anchors: int = _GROUP_ANCHORS) -> DataFrame:
    """Hard negatives of every anchor among all rows of `vectors` (id, label, vector of long).

    A row's score is its inner product with the anchor; higher scores come first, ties by smaller id. For each
    anchor and each of its first `positives` other rows of the same label: the first `negatives` rows of other
    labels whose score lies within the percentages of the positive's score, both ends included.
    `is_anchor` picks the anchors by columns id and label.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Defined cases: rows with a null label or vector take no part; rows without id come last among ties; each of
    several rows with one id stands alone, as anchor, positive and negative; a vector that is shorter than another has
    zeros there; scores beyond long are set to its ends; anchors without positives, and positives without a
    score in their window, give no row; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    p = params
    rows = cut(vectors.where("label IS NOT NULL AND vector IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(_NO_ID)).alias("id"),
        F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    # a small table is cut into more slices, so that all cores have a cell
    slices = max(-(-n // slice_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    groups = max(-(-n_anchors // group_anchors), 1)

    def positives(key, mine: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if mine.num_rows and anchors.num_rows:
            cell = Cell(mine, anchors)
            keep = _nearest(cell, p.positives)
            for a, row, label in zip(cell.anchors, *(anchors.column(c).to_pylist() for c in ("row", "label"))):
                at, scores = cell.scan(a, (cell.labels == label) & (cell.row != row), keep)
                top = cell.best(at, scores, p.positives)
                out += zip([row] * len(top), cell.ids[at[top]].tolist(), _long(scores[top]))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["row", "positive_id", "positive_score"])

    anchors = rows.where("anchor")
    near = _cells(rows, anchors.select("row", "label", "vector"), slices, groups, positives,
                  "row long, positive_id long, positive_score long")
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = (near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= p.positives)
              .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p")))
    asked = cut(anchors.join(chosen, "row").select("row", "label", "vector", F.col("p.positive_score").alias("scores"),
                                                   F.col("p.positive_id").alias("positives"), F.col("id").alias("anchor_id")))

    def negatives(key, mine: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if mine.num_rows and anchors.num_rows:
            cell = Cell(mine, anchors)
            for a, row, label, scores in zip(cell.anchors, *(anchors.column(c).to_pylist() for c in ("row", "label", "scores"))):
                windows = {k: (-(-p.low_percent * s // 100), p.high_percent * s // 100) for k, s in enumerate(scores)}
                windows = {k: w for k, w in windows.items() if w[0] <= w[1]}
                if not windows:
                    continue
                at, found = cell.scan(a, cell.labels != label, _in_windows(list(windows.values()), p.negatives))
                for k, (low, high) in windows.items():
                    inside = np.flatnonzero((found >= low) & (found <= high))
                    top = inside[cell.best(at[inside], found[inside], p.negatives)]
                    out += zip([row] * len(top), [k] * len(top), cell.ids[at[top]].tolist(), _long(found[top]))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["row", "place", "negative_id", "negative_score"])

    hard = _cells(rows, asked.select("row", "label", "vector", "scores"), slices, groups, negatives,
                  "row long, place long, negative_id long, negative_score long")
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.negatives)

    def known(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)

    return (ranked.join(asked.select("row", "anchor_id", F.posexplode(F.arrays_zip("positives", "scores")).alias("place", "p")),
                        ["row", "place"])
            .select(known("anchor_id"), F.nullif(F.col("p.positives"), F.lit(_NO_ID)).alias("positive_id"), "rank",
                    known("negative_id"), F.col("p.scores").alias("positive_score"), "negative_score"))
