"""Exact join of documents by the Jaccard similarity of their word n-grams, with count-vector R-trees.

Shingles are hashed into groups; the counts of a document's shingles in the groups are a point. What two
documents share is at most the sum of the smaller coordinates, and for two boxes of points at most that sum
over their upper corners. An R-tree over the points therefore leaves out whole boxes, and only pairs that
the bound cannot rule out are verified on their full sets.

To spread the work, the points are dealt to many small trees. Two sets that are similar enough must share
one of the rarest shingles of each (the first n - ceil(t n) + 1 in one order for all), so there is one tree
for every shingle that is among the rarest of two sets or more. The order puts common shingles last: those
that many documents of some part of the input hold, by count, and the others before them by hash.

Documents with equal sets are one point. Before the trees are searched, each set is verified against the one
that most of its trees have as their centre, if the bound allows, which joins nearly all members of large
groups of near copies; trees then only look for pairs that are not connected yet. Full sets are only made
again, from the texts, for pairs that the bound has let through. A crowded tree is cut into leaves by size, and
pairs of leaves whose boxes may meet are worked on apart, so no task holds a whole crowded tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.graph import components
from burstline.llm.hashing import batches, mixed, shingles_of, words_of
from burstline.llm.text import text_or_empty
from burstline.llm.workers import tidy

# shingles that stand last in the order: at most so many, which bounds what every task is sent
MAX_COMMON = 200_000
_COMMON_IN_PART = 8
# bits of the filter by which texts are read again: at most 4 MB, however many sets there are
_FILTER_BITS = 1 << 25


@dataclass(frozen=True)
class JoinParams:
    size: int = 4  # words in a shingle
    percent: int = 85  # least similarity: 100 * shared >= percent * all
    groups: int = 512  # coordinates of a point, more for large sets
    leaf: int = 512  # points in a leaf that is worked on by itself


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Shingles that sets of n and m must share: shared * (100 + percent) >= percent * (n + m)."""
    return -(-(percent * (n + m)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-(percent * n) // 100) + 1


# bytes of texts whose sets are made together; within as many, common shingles are told by their counts
_BATCH = 4 << 20


# ---- sets of shingles -------------------------------------------------------------------------------------


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[range, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of each text, in parts of bounded size."""
    for part in batches(texts, pc.binary_length(texts).to_pylist(), _BATCH):
        raw = texts.slice(part.start, len(part)).cast(pa.binary()).to_pylist()
        yield part, [np.unique(s) for s in shingles_of(*words_of(raw, lower=True), size)]


def _identity(sets: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, and two independent hashes of each set; 0 for empty sets."""
    n = np.array([len(s) for s in sets], np.int64)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        every = np.concatenate(sets)
        at = (np.cumsum(n) - n)[full]
        one[full] = np.add.reduceat(mixed(every + np.uint64(2 * seed + 1)), at)
        two[full] = np.bitwise_xor.reduceat(mixed(every ^ np.uint64(0x5DEECE66D)), at)
    return n, mixed(one).view(np.int64), two.view(np.int64)


def _measure(docs: DataFrame, params: JoinParams, seed: int) -> DataFrame:
    """(doc_id, key, n, h, check, point) of each row, and rows (n null, h a shingle, check its count) of common shingles."""
    names = ["doc_id", "key", "n", "h", "check", "point"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for part, sets in _sets(f.column("text"), params.size):
                n, h, check = _identity(sets, seed)
                ids, keys = (f.column(c).slice(part.start, len(part)) for c in ("doc_id", "key"))
                points = [point(x, params.groups) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(n), pa.array(h), pa.array(check), pa.array(points, pa.binary())], names)
                seen, count = np.unique(np.concatenate(sets), return_counts=True)
                often = count >= _COMMON_IN_PART
                if often.any():
                    k = int(often.sum())
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.nulls(k, pa.int64())] * 3, pa.array(seen[often].view(np.int64)),
                         pa.array(count[often].astype(np.int64)), pa.nulls(k, pa.binary())], names)

    return docs.mapInArrow(tidy(run), "doc_id long, key long, n long, h long, check long, point binary")


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], params: JoinParams, seed: int) -> DataFrame:
    """(key, h, n): the rarest shingles of each set, once for each set of a part."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = shared.value
        for f in frames:
            for part, sets in _sets(f.column("text"), params.size):
                n, h, _ = _identity(sets, seed)
                first = np.unique(h, return_index=True)[1]
                first = first[n[first] > 0]
                if not len(first):
                    continue
                every = np.concatenate([sets[i] for i in first])
                rank = np.zeros(len(every), np.int64)
                if len(shingles):
                    at = np.minimum(np.searchsorted(shingles, every), len(shingles) - 1)
                    rank = np.where(shingles[at] == every, counts[at], 0)
                keys, begin = [], 0
                for i in first:
                    own, r = sets[i], rank[begin:begin + n[i]]
                    begin += n[i]
                    p = prefix_length(int(n[i]), params.percent)
                    keys.append(own[np.argsort(r, kind="stable")[:p]] if r.any() else own[:p])
                times = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(h[first], times)),
                     pa.array(np.repeat(n[first], times).astype(np.int32))], ["key", "h", "n"])

    return docs.mapInArrow(tidy(run), "key long, h long, n int")


def _sets_of(docs: DataFrame, wanted: DataFrame, params: JoinParams, seed: int) -> DataFrame:
    """(h, members) of the sets whose h is in `wanted`, and by chance a few others.

    The texts are read again through a filter of fixed size.
    """
    slot = F.col("h").bitwiseAND(F.lit(_FILTER_BITS - 1))
    words = (wanted.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))).toArrow()
    filled = np.zeros(_FILTER_BITS // 64, np.uint64)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for f in frames:
            for _, sets in _sets(f.column("text"), params.size):
                n, h, _ = _identity(sets, seed)
                first = np.unique(h, return_index=True)[1]
                at = h[first] & (_FILTER_BITS - 1)
                in_filter = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
                first = first[in_filter.astype(bool) & (n[first] > 0)]
                if len(first):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[first]), pa.array(n[first].astype(np.int32)),
                         pa.array([sets[i].tobytes() for i in first], pa.binary())], ["h", "n", "members"])

    return docs.mapInArrow(tidy(run), "h long, n int, members binary").groupBy("h").agg(F.first("members").alias("members"))


# ---- verification and points ------------------------------------------------------------------------------

# the largest count of a group in a point
_FULL = 15


def _verified(pairs: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            keep = []
            for x, y in zip(f.column("x").to_pylist(), f.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= params.percent * (len(x) + len(y) - both))
            yield f.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("h").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("h").alias("b"), F.col("members").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long"))


def point(members: np.ndarray, groups: int) -> bytes:
    """Counts of the shingles in the groups, 4 bits each, two groups a byte; the largest number stands for all beyond.

    There are `groups` of them, for large sets a multiple by a power of two, so that a group has few members: the fewer,
    the nearer the bound is to what two sets share, and the fewer variants of one text are let through.
    """
    groups += groups % 2
    while groups * 2 < len(members) and groups < 32768:
        groups *= 2
    counts = np.bincount((mixed(members) % np.uint64(groups)).astype(np.int64), minlength=groups)
    counts = np.minimum(counts, _FULL).astype(np.uint8)
    return (counts[:groups // 2] | counts[groups // 2:] << 4).tobytes()


def width_of(point: bytes) -> int:
    return 2 * len(point)


def unpacked(points: list[bytes], width: int) -> np.ndarray:
    """One row a point, brought to `width` groups: those whose numbers agree modulo `width` add up.

    A count beyond 4 bits becomes so large that no bound can rule it out.
    """
    out = np.empty((len(points), width), np.int64)
    sizes = np.fromiter(map(width_of, points), np.int64, len(points))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        two = np.frombuffer(b"".join([points[i] for i in rows]), np.uint8).reshape(len(rows), size // 2)
        own = np.concatenate([two & 15, two >> 4], axis=1)
        folds = own.reshape(len(rows), size // width, width)
        small = size // width * _FULL < 256
        out[rows] = folds.sum(axis=1, dtype=np.uint8 if small else np.int64)
        full = np.flatnonzero((own == _FULL).any(axis=1))
        out[rows[full]] += (folds[full] == _FULL).sum(axis=1) << 40
    return out


def possible(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of points (sizes n and m) the sum of smaller coordinates cannot rule out."""
    out = (100 * m >= percent * n) & (100 * n >= percent * m)
    width = np.fromiter((min(width_of(a), width_of(b)) for a, b in zip(x, y)), np.int64, len(n))
    for w in np.unique(width[out]).tolist():
        # most are ruled out by fewer groups already
        for few in (_coarse(w), w):
            rows = np.flatnonzero(out & (width == w))
            for part in np.array_split(rows, len(rows) * few // (2 << 20) + 1):
                shared = np.minimum(unpacked([x[i] for i in part], few), unpacked([y[i] for i in part], few)).sum(axis=1)
                out[part] = shared >= needed(n[part], m[part], percent)
    return out


def _coarse(width: int) -> int:
    return width // 4 if width % 4 == 0 else width


class CountTree:
    """An R-tree of points in two levels, packed by size and then by the coordinate that varies most.

    Only upper corners are kept: they bound the overlap of what lies below.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16) -> None:
        order = np.argsort(sizes, kind="stable")
        widest = int(np.argmax(points.var(axis=0))) if len(points) else 0
        order = np.concatenate([part[np.argsort(points[part, widest], kind="stable")]
                                for part in np.array_split(order, max(1, len(order) // (fan * fan)))])
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.starts = np.arange(0, len(order), fan)
        self.corners = np.maximum.reduceat(self.points, self.starts)
        self.least = np.minimum.reduceat(self.sizes, self.starts)
        self.most = np.maximum.reduceat(self.sizes, self.starts)
        self.ends = np.append(self.starts[1:], len(order))

    def pairs(self, other: CountTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the two trees that may be similar enough, by sizes and by the sum of smaller coordinates."""
        left, right = [], []
        for i in range(len(self.starts)):
            alike = np.flatnonzero((100 * other.most >= percent * self.least[i]) & (100 * self.most[i] >= percent * other.least))
            if not len(alike):
                continue
            bound = np.minimum(self.corners[i], other.corners[alike]).sum(axis=1)
            alike = alike[bound >= needed(self.least[i], other.least[alike], percent)]
            if not len(alike):
                continue
            rows = np.concatenate([np.arange(other.starts[j], other.ends[j]) for j in alike])
            for x in range(self.starts[i], self.ends[i]):
                bound = np.minimum(self.points[x], other.points[rows]).sum(axis=1)
                hit = rows[bound >= needed(self.sizes[x], other.sizes[rows], percent)]
                left.append(np.full(len(hit), self.order[x]))
                right.append(other.order[hit])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])


# trees of so few points are searched pair by pair, many at once
_FEW = 48


def _few(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside each of many small trees, in parts of bounded size."""
    for size in np.unique(counts):
        one, two = np.triu_indices(int(size), 1)
        own = starts[counts == size]
        for part in np.array_split(own, len(own) * len(one) // 1_000_000 + 1):
            yield (part[:, None] + one).ravel(), (part[:, None] + two).ravel()


def _searched(batch: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs (a, b) in different components that the bound lets through, in each tree of `batch`.

    Rows of a tree, or of two leaves of a crowded one, stand together in the order of `other` and n.
    """
    h, n, root, other = (batch[c].to_numpy() for c in ("h", "n", "root", "other"))
    n, points = n.astype(np.int64), batch["point"].tolist()
    tree = batch[["key", "from", "to"]].to_numpy()
    starts = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]).any(axis=1)))
    ends = np.append(starts[1:], len(batch))
    few = (ends - starts <= _FEW) & (tree[starts, 1] == tree[starts, 2])
    found = [np.empty((0, 2), np.int64)]

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        ok = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        pairs = np.sort(np.stack([h[x], h[y]], axis=1), axis=1)
        if len(pairs):
            pairs, at = np.unique(pairs, axis=0, return_index=True)
            x, y = x[at], y[at]
            found.append(pairs[possible([points[i] for i in x], [points[i] for i in y], n[x], n[y], percent)])

    for x, y in _few(starts[few], (ends - starts)[few]):
        keep(x, y)
    for lo, hi in zip(starts[~few], ends[~few]):
        cut_at = lo + int((~other[lo:hi]).sum())
        one, two = np.arange(lo, cut_at), np.arange(cut_at, hi)
        width = _coarse(min(map(width_of, points[lo:hi])))
        a = CountTree(unpacked(points[lo:cut_at], width), n[one])
        b = CountTree(unpacked(points[cut_at:hi], width), n[two]) if len(two) else a
        x, y = a.pairs(b, percent)
        keep(one[x], (two if len(two) else one)[y])
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _candidates(members: DataFrame, points: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs (a, b) that some tree of `members` (key, h, n, root) cannot rule out."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "h")) - 1
    placed = cut(members.withColumn("leaf", F.floor(place / params.leaf).cast("int")))
    leaves = cut(placed.groupBy("key", "leaf").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    # leaves are in the order of size: a later one can only be too large
    later = leaves.select("key", F.col("leaf").alias("to"), F.col("lo").alias("to_lo"))
    meet = (leaves.join(later, "key").where("to >= leaf")
            .where(F.col("to_lo").cast("long") * params.percent <= F.col("hi").cast("long") * 100).select("key", "leaf", "to"))
    sides = (meet.select("key", F.col("leaf").alias("from"), "to", "leaf", F.lit(False).alias("other"))
             .union(meet.where("to > leaf").select("key", F.col("leaf").alias("from"), "to", F.col("to").alias("leaf"), F.lit(True))))
    rows = placed.join(sides, ["key", "leaf"]).join(points, "h").select("key", "from", "to", "h", "n", "root", "other", "point")
    percent = params.percent

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            last = f[["key", "from", "to"]].iloc[-1]
            open_tree = (f["key"] == last["key"]) & (f["from"] == last["from"]) & (f["to"] == last["to"])
            held = f[open_tree].reset_index(drop=True)
            if not open_tree.all():
                yield _searched(f[~open_tree].reset_index(drop=True), percent)
        if held is not None:
            yield _searched(held, percent)

    return (rows.repartition("key", "from", "to").sortWithinPartitions("key", "from", "to", "other", "n", "h")
            .mapInPandas(tidy(run), "a long, b long").distinct())


def _bounded(pairs: DataFrame, points: DataFrame, params: JoinParams) -> DataFrame:
    """The rows of `pairs` (a, b, votes) that the bound lets through."""
    percent = params.percent

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            x, y = (f.column(c).to_pylist() for c in ("x", "y"))
            n, m = (f.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            yield f.select(["a", "b", "votes"]).filter(pa.array(possible(x, y, n, m, percent)))

    return (pairs.join(points.select(F.col("h").alias("a"), "n", F.col("point").alias("x")), "a")
            .join(points.select(F.col("h").alias("b"), F.col("n").alias("m"), F.col("point").alias("y")), "b")
            .where(F.least("n", "m").cast("long") * 100 >= F.greatest("n", "m").cast("long") * percent)
            .select("a", "b", "votes", "n", "m", "x", "y").mapInArrow(tidy(run), "a long, b long, votes long"))


# ---- the join ---------------------------------------------------------------------------------------------


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    top = (rows.where("n IS NULL").groupBy("h").agg(F.sum("check").alias("count"))
           .orderBy(F.desc("count"), "h").limit(MAX_COMMON).toArrow())
    shingles = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], top.column("count").to_numpy()[order]


def _links(docs: DataFrame, measured: DataFrame, classes: DataFrame, params: JoinParams, seed: int) -> DataFrame:
    """(node, root) of the sets that are linked with another one."""
    keys = _prefixes(docs, _common(measured), params, seed)
    tree = Window.partitionBy("key")
    keys = keys.select("*", F.min("h").over(tree).alias("first"), F.max("h").over(tree).alias("last"))
    members = cut(keys.where("first <> last").select("key", "h", "n").distinct()
                  .withColumn("crowd", F.count("*").over(tree)))
    points = classes.select("h", "n", "point")
    # the centre of a tree is the set that meets most others: that of which the rest are variants
    degree = members.groupBy("h").agg(F.sum("crowd").alias("degree"))
    centred = cut(members.join(degree, "h").select(
        "key", "h", F.max(F.struct("degree", "h")).over(tree)["h"].alias("centre")))
    # each set is first held against its commonest centre
    votes = (centred.where("h <> centre").groupBy(F.col("h").alias("a"), F.col("centre").alias("b"))
             .agg(F.count("*").alias("votes")))
    best = cut(_bounded(votes, points, params).groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best"))
               .select("a", F.col("best.b").alias("b")))
    both = F.explode(F.array("a", "b")).alias("h")
    star = cut(_verified(best, cut(_sets_of(docs, best.select(both).distinct(), params, seed)), params))
    roots = components(star)
    rooted = (members.join(roots.withColumnRenamed("node", "h"), "h", "left")
              .select("key", "h", "n", F.coalesce("root", "h").alias("root")))
    # trees of one component have nothing left to find; equal lists of members make equal trees
    open_trees = rooted.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.expr("bit_xor(xxhash64(h))").alias("one"),
        F.sum(F.xxhash64(F.lit(1), "h").cast("decimal(38,0)")).alias("two"), F.count("*").alias("k")).where("lo <> hi")
    once = open_trees.groupBy("one", "two", "k").agg(F.min("key").alias("key"))
    rooted = cut(rooted.join(once.select("key"), "key", "left_semi"))
    pairs = cut(_candidates(rooted, points.select("h", "point"), params))
    sets = cut(_sets_of(docs, pairs.select(both).distinct(), params, seed))
    return components(star.union(_verified(pairs, sets, params)))


def _groups(docs: DataFrame, id_col: str, text_col: str, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, n, h), and of each set with shingles (h, root, least): its group and the first row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    for seed in range(8):
        measured = cut(_measure(keyed, params, seed))
        base = measured.where("n IS NOT NULL")
        classes = cut(base.where("n > 0").groupBy("h").agg(
            F.min("check").alias("lo"), F.max("check").alias("hi"), first.alias("least"),
            F.min("n").cast("int").alias("n"), F.min("point").alias("point")))
        # two different sets with one 64-bit hash: take another hash
        if classes.where("lo <> hi").isEmpty():
            break
    roots = _links(rows.select("text"), measured, classes, params, seed).withColumnRenamed("node", "h")
    return base, cut(classes.join(roots, "h", "left").select("h", "least", F.coalesce("root", "h").alias("root")))


def linked_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     params: JoinParams = JoinParams()) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, and class_id, the smallest id with an equal set.

    Texts are lower-cased (A-Z) and cut into words at space and 0x09-0x0D; a set holds the distinct shingles
    of `size` words, of a shorter text the whole sequence. Two rows link when 100 * shared >= percent * all;
    component_id is the smallest id reachable by links.

    Defined cases: null texts, and texts without words, have no shingles and link with nothing; equal sets
    link; null ids take part and are never the smallest unless a component has no other; repeated rows link;
    other columns are ignored; an empty table gives no rows.
    """
    base, classes = _groups(docs, id_col, text_col, params)
    least = classes.groupBy("root").agg(F.min("least")["doc_id"].alias("component"))
    parts = cut(classes.join(least, "root").select("h", "component", F.col("least.doc_id").alias("class")))
    # a class that a third of all rows share is one row here and many there: Spark splits such joins
    def of(name: str) -> Column:
        return F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(name)).alias(name + "_id")

    return base.join(parts, "h", "left").select("doc_id", F.col("n").alias("n_shingles"), of("component"), of("class"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      params: JoinParams = JoinParams()) -> DataFrame:
    """`docs` with the row of the smallest id of each group of linked rows, all columns as they were.

    Rows without shingles stay; of rows that are repeated with id and text, one stays.
    """
    base, classes = _groups(docs, id_col, text_col, params)
    kept = cut(classes.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.key")
               .union(base.where("n = 0").select("doc_id", "key").distinct()))
    ids = F.col(id_col).cast("long")
    rows = docs.select(F.struct("*").alias("rec"), ids.alias("doc_id"),
                       F.xxhash64(ids, text_or_empty(text_col)).alias("key"))
    left = rows.join(kept, (rows["key"] == kept["key"]) & rows["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy(F.lit(0)))
    return left.withColumn("nth", nth).where("nth = 1").select("rec.*")
