"""Removing repeated passages of bytes by suffix order, built column by column.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Strings
are compared in suffix order of many short segments at once, which is built as in external construction of
the Burrows-Wheeler transform of a collection: each round puts one more symbol of every segment in front of
its last suffix, finds where the new suffixes belong from the transform so far, and rewrites the transform
and the suffixes in one sequential pass. After as many rounds as the longest segment has bytes, suffixes
that share their first `length` bytes stand together; common prefixes are compared up to that length.

Later copies of whole texts go at once, and are left out of the search. To spread the rest, every window of `length` bytes has an anchor, the first place in it where the hash of a
short string is smallest; windows with one anchor are a segment, so equal windows always meet under the same
anchor hash, wherever they come from. An anchor that lies in the left half of a window has a string of fixed
length on its right inside the window, else on its left; where those strings occur once in the whole
corpus, the windows cannot repeat anything. Only segments with such a string that occurs again are made, each
once in a batch of documents however often it occurs there, and dealt out by anchor. Each round's arrays are in memory, as the segments of a task are bounded;
what goes between tasks are shuffled and written tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.lineage import cut, free
from burstline.llm.hashing import batches, mixed
from burstline.llm.text import text_or_empty

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_FIRST = np.uint64(0xFFFFFFFF00000000)
_END = 255  # never a byte of UTF-8
_COLUMNS = 6  # of the transform that are written in one pass
_NEAR = 1 << 15  # places that are worked on at a time, whose numbers fit in a core's own cache
_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class RepeatParams:
    length: int = 50  # bytes
    task_bytes: int = 2 << 20  # of text for each task that sorts segments
    key_bytes: int = 16 << 20  # of text for each task that counts strings beside anchors
    common: int = 512  # an anchor that occurs so often, as counted in batches that have it `often` times, is common
    often: int = 4
    filter_bits: int = 31  # the filter of such strings has at most 2 ** filter_bits bits (256 MB)


# later copies of whole texts are left out of the search by a list that every task gets, up to this many; else by a join
SMALL_TABLE = 500_000
# bytes of an anchor
_ANCHOR = 16
# common anchors that every task is sent, at most
_MAX_COMMON = 200_000


# ---- anchors and segments ---------------------------------------------------------------------------------


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on, block by block, so that all steps of a block stay near."""
    raw = np.append(data, np.zeros(24, np.uint8))
    out = np.empty(len(data), np.uint64)
    for lo in range(0, len(data), _NEAR):
        n = min(_NEAR, len(data) - lo)
        eight = np.empty(n + 8, np.uint64)
        for k in range(8):
            own = eight[k::8]
            own[:] = np.frombuffer(raw, "<u8", count=len(own), offset=lo + k)
        # 16 bytes are two numbers of 8
        x = eight[:-8] * _C1 + (eight[8:] ^ (eight[8:] >> np.uint64(31))) * _C2
        x ^= x >> np.uint64(29)
        x *= _C3
        np.bitwise_xor(x, x >> np.uint64(32), out=out[lo:lo + n])
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least, by the first 32 bits, of `width` neighbours from each place on, as far as there are so many."""
    out = np.empty(max(len(x) - width + 1, 0), np.int32)
    for lo in range(0, len(out), _NEAR):
        n = min(_NEAR, len(out) - lo)
        # the place in the block stands behind the bits
        least = (x[lo:lo + n + width - 1] & _FIRST) | np.arange(n + width - 1, dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        out[lo:lo + n] = (least & ~_FIRST).astype(np.int32) + np.int32(lo)
    return out


def runs_of(texts: list[bytes], params: RepeatParams) -> tuple:
    """(buffer, document, start, windows, anchor, keys, lead) of the runs of windows with one anchor, in order.

    `keys` has two columns, hashes of the strings right and left of the anchor; 0 where no window of the run has
    it. `lead` is the number of bytes between the run's start and its anchor.
    """
    buffer = b"\xff".join(texts) + b"\xff"
    data = np.frombuffer(buffer, np.uint8)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    windows = np.maximum(lengths - params.length + 1, 0)
    none = np.empty(0, np.int64)
    if not windows.any():
        return buffer, none, none, none, np.empty(0, np.uint64), np.empty((0, 2), np.uint64), none
    hashes = _anchor_hashes(data)
    spare = params.length - _ANCHOR  # an anchor has so many places in a window
    place = _sliding_least(hashes, spare + 1)
    has = np.flatnonzero(windows)
    change = np.zeros(len(data) + 1, bool)
    change[1:len(place)] = place[1:] != place[:-1]
    change[begins[has]] = True
    change[begins[has] + windows[has]] = True  # what follows the last window of a document is no run
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, len(data)))
    doc = np.searchsorted(begins, start, side="right") - 1
    real = start < begins[doc] + windows[doc]
    start, size, doc = start[real], size[real], doc[real]
    at = place[start].astype(np.int64)
    # with at most `half` bytes of the window in front of its anchor, as many stand behind it, and the other way round
    half = spare // 2
    keys = np.zeros((len(at), 2), np.uint64)
    for side, (wanted, far) in enumerate(((at - (start + size - 1) <= half, at + half), (at - start > half, at - half))):
        one, two = hashes[at[wanted]], hashes[far[wanted]]
        # strings of up to three anchors' length are told by the anchors at their ends and in the middle
        middle = hashes[(at[wanted] + far[wanted]) // 2]
        both = ((one * _C1 + middle) * _C2 + two) * _C3 + np.uint64(side)
        keys[wanted, side] = (both ^ (both >> np.uint64(32))) | np.uint64(1)
    return buffer, doc, start - begins[doc], size, mixed(hashes[at]), keys, at - start


def _parts(texts: list[bytes]) -> Iterator[range]:
    yield from batches(texts, [len(t) for t in texts])


# ---- which strings occur again ----------------------------------------------------------------------------


def _task_bits(total: int, task_bytes: int) -> int:
    return (total // task_bytes).bit_length()


def _shift(x: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` bits."""
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _slices(values: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """Sorted values by task."""
    task = _shift(values, bits)
    edges = np.append(np.flatnonzero(np.diff(task, prepend=-1)), len(task))
    return {int(task[a]): values[a:b] for a, b in zip(edges, edges[1:])}


def _key_bytes(total: int) -> int:
    """Bytes of a key that are sent: with so many, about one of a hundred keys agrees with another by chance at most."""
    return min(8, max(5, -(-(total.bit_length() + 5) // 8)))


def _again(rows: DataFrame, bits: int, width: int, params: RepeatParams) -> DataFrame:
    """(task, n, keys, common): keys that occur more than once, and common anchors with their counts.

    A batch sends the first `width` bytes of a key once, their last bit set if it has the key more than once; keys
    that differ later only make segments that repeat nothing.
    """
    drop = np.uint64(64 - 8 * width)
    one = drop + np.uint64(1)

    def sent(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            raw = f.column("text").cast(pa.binary()).to_pylist()
            for part in _parts(raw):
                *_, anchor, keys, _ = runs_of([raw[i] for i in part], params)
                found, count = np.unique(keys[keys > 0] >> one, return_counts=True)
                marked = (found << one) | ((count > 1).astype(np.uint64) << drop)
                often, times = np.unique(anchor, return_counts=True)
                often, times = often[times >= params.often], times[times >= params.often]
                by_task, common, at = _slices(marked, bits), _slices(often, bits), 0
                out: list[list] = [[], [], []]
                for task in sorted({*by_task, *common}):
                    short = (by_task.get(task, marked[:0]) >> drop).view(np.uint8).reshape(-1, 8)[:, :width]
                    own = common.get(task, often[:0])
                    both = np.stack([own, times[at:at + len(own)].astype(np.uint64)])
                    at += len(own)
                    for col, value in zip(out, (task, short.tobytes(), both.tobytes())):
                        col.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_pydict({"task": out[0], "keys": out[1], "common": out[2]})

    def met(key: tuple, table: pa.Table) -> pa.Table:
        short = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, width)
        every = np.zeros((len(short), 8), np.uint8)
        every[:, :width] = short
        every = np.sort(every.view(np.uint64).ravel())
        plain = every >> np.uint64(1)
        twice = (every & np.uint64(1)).astype(bool)
        twice[1:] |= plain[1:] == plain[:-1]
        found = np.unique(plain[twice]) << one
        counted = [np.frombuffer(c, np.uint64).reshape(2, -1) for c in table.column("common").to_pylist()]
        anchors, of = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
        times = np.bincount(of, weights=np.concatenate([c[1] for c in counted]), minlength=len(anchors)).astype(np.int64)
        common = np.stack([anchors, times.astype(np.uint64)])[:, times >= params.common]
        return pa.table({"task": [key[0].as_py()], "n": [len(found)], "keys": [found.tobytes()], "common": [common.tobytes()]})

    return (rows.mapInArrow(sent, "task long, keys binary, common binary").groupBy("task")
            .applyInArrow(met, "task long, n long, keys binary, common binary"))


def _common(again: DataFrame) -> np.ndarray:
    """The commonest anchors, sorted; at most _MAX_COMMON."""
    best = np.empty((2, 0), np.uint64)
    for r in again.where(F.length("common") > 0).select("common").toLocalIterator():
        best = np.concatenate([best, np.frombuffer(r["common"], np.uint64).reshape(2, -1)], axis=1)
        if best.shape[1] > 2 * _MAX_COMMON:
            best = best[:, np.argsort(best[1])[-_MAX_COMMON:]]
    return np.sort(best[0, np.argsort(best[1])[-_MAX_COMMON:]])


def _filter(again: DataFrame, bits: int, params: RepeatParams) -> tuple[np.ndarray, int]:
    """A bit map over the first `wide` bits of the keys in `again`, of a size that keeps it sparse up to a bound."""
    total = again.agg(F.sum("n")).first()[0] or 0
    wide = min(max((16 * total).bit_length(), bits + 3), max(params.filter_bits, bits + 3))
    step = 1 << (wide - bits)

    def mapped(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for task, raw in zip(f.column("task").to_pylist(), f.column("keys").to_pylist()):
                own = np.zeros(step, bool)
                own[_shift(np.frombuffer(raw, np.uint64), wide) - task * step] = True
                yield pa.RecordBatch.from_pydict({"task": [task], "map": [np.packbits(own).tobytes()]})

    out = np.zeros((1 << wide) // 8, np.uint8)
    for r in again.mapInArrow(mapped, "task long, map binary").toLocalIterator():
        out[r["task"] * step // 8:(r["task"] + 1) * step // 8] = np.frombuffer(r["map"], np.uint8)
    return out, wide


# ---- segments ---------------------------------------------------------------------------------------------


def _segments(rows: DataFrame, bitmap: np.ndarray, wide: int, common: np.ndarray, bits: int, params: RepeatParams) -> DataFrame:
    """Per batch and task: the distinct segments with the least id that has each, and where they occur.

    (batch, task, segments, sizes, least, owners): sizes and least are arrays, owners a packed table of segment
    number, doc_id, key and start.
    """
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, common))
    reach = params.length - 1

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, common = shared.value
        batch = TaskContext.get().partitionId() << 33
        for f in frames:
            raw = f.column("text").cast(pa.binary()).to_pylist()
            ids, own_keys = f.column("id").to_numpy(), f.column("key").to_numpy()
            for part in _parts(raw):
                buffer, doc, start, size, anchor, keys, lead = runs_of([raw[i] for i in part], params)
                slot = _shift(keys, wide)
                again = ((bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool) & (keys > 0)
                # windows with the string on the right begin `half` bytes before the anchor, or later
                first = lead - (params.length - _ANCHOR) // 2
                skip = np.where(again[:, 1], 0, np.maximum(first, 0))
                size = np.where(again[:, 0], size, np.minimum(size, np.maximum(first, 0))) - skip
                hit = np.flatnonzero(again.any(axis=1) & (size > 0))
                if not len(hit):
                    continue
                batch += 1
                doc, start, size, task = doc[hit], (start + skip)[hit], size[hit], anchor[hit]
                if len(common):
                    near = np.minimum(np.searchsorted(common, task), len(common) - 1)
                    alone = np.where(common[near] == task, size, 1)
                    of = np.repeat(np.arange(len(task)), alone)
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(alone) - alone, alone)
                    single = (common[near] == task)[of]
                    doc, start, size, task = doc[of], start[of] + nth, np.where(single, 1, size[of]), task[of]
                begins = np.cumsum([0] + [len(raw[i]) + 1 for i in part])
                at = begins[doc] + start
                if len(common) and single.any():
                    # dealt out by all anchors' worth of bytes of the one window
                    h, far = _anchor_hashes(np.frombuffer(buffer, np.uint8)), params.length - _ANCHOR
                    own = at[single]
                    task[single] = mixed(((h[own] * _C1 + h[own + far // 3]) * _C2 + h[own + 2 * far // 3]) * _C3 + h[own + far])
                task = _shift(task, bits)
                texts = [buffer[a:b] for a, b in zip(at.tolist(), (at + size + reach).tolist())]
                doc += part.start
                order = np.argsort(task, kind="stable")
                edges = np.append(np.flatnonzero(np.diff(task[order], prepend=-1)), len(order))
                out: list[list] = [[] for _ in range(6)]
                for lo, hi in zip(edges, edges[1:]):
                    own = order[lo:hi]
                    numbers: dict[bytes, int] = {}
                    of = np.array([numbers.setdefault(texts[i], len(numbers)) for i in own.tolist()], np.int64)
                    least = np.full(len(numbers), _NO_ID)
                    np.minimum.at(least, of, ids[doc[own]])
                    owners = np.stack([of, ids[doc[own]], own_keys[doc[own]], start[own]])
                    for col, value in zip(out, (batch, int(task[own[0]]), zlib.compress(b"".join(numbers), 1),
                                                np.array([len(s) for s in numbers], "<i4").tobytes(), least.tobytes(),
                                                zlib.compress(owners.tobytes(), 1))):
                        col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])],
                    ["batch", "task", "segments", "sizes", "least", "owners"])

    return rows.mapInArrow(run, "batch long, task long, segments binary, sizes binary, least binary, owners binary")


# ---- suffix order -----------------------------------------------------------------------------------------


def _pushed(old: np.ndarray, at: np.ndarray, values: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """`old` at the places `kept` and `values` at the places `at` of a longer array, in one pass."""
    out = np.empty(len(kept), old.dtype)
    out[kept] = old
    out[at] = values
    return out


def _ranked(text: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Symbols (of the places `among` has) with their places as one number each, in order.

    Blocks are put in order by themselves, then their runs of each symbol in a row.
    """
    blocks, bounds = [], []
    for lo in range(0, len(text), _NEAR):
        own = text[lo:lo + _NEAR]
        order = np.argsort(own, kind="stable")
        if among is not None:
            order = order[among[lo:lo + _NEAR][order]]
        symbols = own[order].astype(np.int64)
        blocks.append((symbols << 40) | (order + lo))
        bounds.append(np.searchsorted(symbols, np.arange(257)).tolist())
    return np.concatenate([k[b[c]:b[c + 1]] for c in range(256) for k, b in zip(blocks, bounds) if b[c] < b[c + 1]] or [np.empty(0, np.int64)])


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes of the segments data[...:end] in lexicographic order; equal ones by segment.

    Column-wise: `text` is the transform so far, the symbol in front of each suffix in order. Empty suffixes stand
    first. A suffix longer by the symbol c comes, among those that begin with c, in the order of what follows:
    its rank is the rank of its symbol in the transform.

    The transform is not rewritten for each column. New rows go to a small table beside it, where each knows how many
    rows of the transform stand before it, and so its rank is counted in both; after `_COLUMNS` columns one
    sequential pass writes them into the transform. Where the suffixes stand is read off the last one: from the rank
    of a suffix that of the suffix longer by one symbol follows, column after column.
    """
    starts = np.append(0, ends[:-1])
    first = len(ends)
    text = data[ends - 1]
    active = np.arange(first)  # segments in the order of their last suffixes, which stand in the transform at `at`
    at = np.arange(first)
    level = ends.copy()  # where these suffixes begin
    while len(active):
        settled = np.ones(len(text), bool)
        settled[at] = False
        older = _ranked(text, settled)  # symbols whose longer suffixes are in the transform
        # beside it: the last suffixes and, from column to column, what is new
        front, beside, before = at, text[at], at
        own = np.zeros(len(at), bool)  # new rows
        near = np.arange(len(at))
        for _ in range(_COLUMNS):
            symbol = beside[near].astype(np.int64)
            order = np.argsort(beside[near], kind="stable")
            active, symbol, near = active[order], symbol[order] << 40, near[order]
            ahead = first + np.searchsorted(older, symbol | before[near])
            rank = np.empty(len(beside), np.int64)
            rank[np.argsort(beside, kind="stable")] = np.arange(len(beside))
            near = rank[near] + np.searchsorted(front, ahead)
            level = level[order] - 1
            added = np.where(level > starts[active], data[level - 1], _END).astype(np.uint8)
            kept = np.ones(len(beside) + len(active), bool)
            kept[near] = False
            beside, before, own = (_pushed(x, near, y, kept) for x, y in ((beside, added), (before, ahead), (own, True)))
            more = added != _END
            active, near, level = active[more], near[more], level[more]
            if not len(active):
                break
        # one sequential pass writes the next transform
        fresh = np.flatnonzero(own)
        to = before[fresh] + np.arange(len(fresh))
        kept = np.ones(len(text) + len(fresh), bool)
        kept[to] = False
        text = _pushed(text, to, beside[fresh], kept)
        at = to[(np.cumsum(own) - 1)[near]]
    rank = np.empty(len(text), np.int32)
    rank[_ranked(text) & ((1 << 40) - 1)] = np.arange(first, first + len(text), dtype=np.int32)
    places = np.empty(len(text), np.int32)
    places[:first] = ends
    at, level, stop = np.arange(first), ends, starts
    while len(at):
        more = level > stop
        at, level, stop = rank[at[more]], level[more] - 1, stop[more]
        places[at] = level
    return places


def least_owners(segments: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, bounds): for each window of `length` bytes of segment i, value[bounds[i]:bounds[i + 1]] is the least
    owner of any segment that has the window."""
    sizes = np.fromiter((len(s) for s in segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(segments), np.uint8)
    places = suffix_order(data, ends).astype(np.int64)
    of = np.searchsorted(ends, places, side="right")
    long = np.flatnonzero(of < len(ends))
    long = long[ends[of[long]] - places[long] >= length]
    places, of = places[long], of[long]
    same = np.zeros(len(places), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else data[:0].reshape(0, length)
    for lo in range(1, len(places), 1 << 16):
        hi = min(len(places), lo + (1 << 16))
        same[lo:hi] = (view[places[lo:hi]] == view[places[lo - 1:hi - 1]]).all(axis=1)
    group = np.flatnonzero(~same)
    owner = np.minimum.reduceat(least[of], group) if len(group) else least[:0]
    windows = np.maximum(sizes - length + 1, 0)
    bounds = np.append(0, np.cumsum(windows))
    value = np.empty(int(bounds[-1]), np.int64)
    value[bounds[of] + places - (ends[of] - sizes[of])] = np.repeat(owner, np.diff(np.append(group, len(places))))
    return value, bounds


def _judged(made: DataFrame, params: RepeatParams) -> DataFrame:
    """(batch, task, found): for the segments of a batch, runs of windows and the least id that has them, packed as
    segment number, first window, windows, id."""
    length = params.length

    def run(key: tuple, table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        least: list[int] = []
        members: list[list[int]] = []
        for raw, sizes, ids in zip(*(table.column(c).to_pylist() for c in ("segments", "sizes", "least"))):
            raw, ends = zlib.decompress(raw), np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
            own = []
            for a, b, i in zip([0, *ends], ends, np.frombuffer(ids, np.int64).tolist()):
                n = numbers.setdefault(raw[a:b], len(numbers))
                if n == len(least):
                    least.append(i)
                elif i < least[n]:
                    least[n] = i
                own.append(n)
            members.append(own)
        value, bounds = least_owners(list(numbers), np.array(least, np.int64), length)
        # runs of windows with one owner
        change = np.ones(len(value), bool)
        change[1:] = value[1:] != value[:-1]
        change[bounds[:-1]] = True
        begin = np.flatnonzero(change)
        segment = np.searchsorted(bounds, begin, side="right") - 1
        runs = np.stack([begin - bounds[segment], np.diff(np.append(begin, len(value))), value[begin]])
        lo = np.searchsorted(segment, np.arange(len(numbers)))
        hi = np.searchsorted(segment, np.arange(len(numbers)), side="right")
        found = []
        for own in members:
            own_at = np.array(own)
            count = (hi - lo)[own_at]
            at = np.repeat(lo[own_at] - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append(zlib.compress(np.vstack([np.repeat(np.arange(len(own_at)), count), runs[:, at]]).tobytes(), 1))
        return pa.table({"batch": table.column("batch"), "task": table.column("task"), "found": pa.array(found, pa.binary())})

    return (made.select("batch", "task", "segments", "sizes", "least").groupBy("task")
            .applyInArrow(run, "batch long, task long, found binary"))


def _spans(made: DataFrame, judged: DataFrame, params: RepeatParams) -> DataFrame:
    """(id, key, spans): bytes to remove of each document, packed as start and end, from one batch and task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            ids, keys, spans = [], [], []
            for owners, found in zip(f.column("owners").to_pylist(), f.column("found").to_pylist()):
                of, doc, key, start = np.frombuffer(zlib.decompress(owners), np.int64).reshape(4, -1)
                segment, first, windows, least = np.frombuffer(zlib.decompress(found), np.int64).reshape(4, -1)
                lo = np.searchsorted(segment, of)
                count = np.searchsorted(segment, of, side="right") - lo
                who = np.repeat(np.arange(len(of)), count)
                at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                go = least[at] < doc[who]
                who, at = who[go], at[go]
                if not len(who):
                    continue
                a = start[who] + first[at]
                b = a + windows[at] + params.length - 1
                order = np.lexsort((a, key[who], doc[who]))
                d, k = doc[who][order], key[who][order]
                edges = np.append(np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))), len(d))
                both = np.stack([a[order], b[order]], axis=1)
                ids += d[edges[:-1]].tolist()
                keys += k[edges[:-1]].tolist()
                spans += [both[x:y].tobytes() for x, y in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(spans, pa.binary())],
                                             ["id", "key", "spans"])

    return (made.select("batch", "task", "owners").join(judged, ["batch", "task"]).select("owners", "found")
            .mapInArrow(run, "id long, key long, spans binary"))


def merged_spans(spans: list[bytes]) -> np.ndarray:
    """Disjoint spans that do not touch, in order."""
    every = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    every = every[np.argsort(every[:, 0], kind="stable")]
    reach = np.maximum.accumulate(every[:, 1])
    begin = np.flatnonzero(np.append(True, every[1:, 0] > reach[:-1]))
    return np.stack([every[begin, 0], reach[np.append(begin[1:] - 1, len(every) - 1)]], axis=1)


# the span of a whole text, however long
_ALL = np.array([0, _NO_ID], np.int64).tobytes()


def _later_copies(rows: DataFrame) -> DataFrame:
    """(id, key, n_bytes) of the rows whose whole text a row with a smaller id has. What they hold, that row holds."""
    digests = cut(rows.select("id", "key", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    least = digests.groupBy("digest", "n_bytes").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = cut(digests.join(least, ["digest", "n_bytes"]).where("id > least").select("id", "key", "n_bytes").distinct())
    free(digests)
    return copies


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   params: RepeatParams = RepeatParams()) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Defined cases: null and too short texts keep all their bytes; a null id counts as larger than any other, and
    null ids remove nothing from each other; rows with one id remove nothing from each other; other columns
    are ignored; an empty table gives no rows.
    """
    if not 2 * _ANCHOR < params.length <= 5 * _ANCHOR:
        raise ValueError("strings of 33 to 80 bytes can be searched")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("doc_id", "text").alias("key"))
    copies = _later_copies(rows)
    few = copies.count() <= SMALL_TABLE
    others = rows.join(F.broadcast(copies) if few else copies, ["id", "key"], "left_anti")
    total = others.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key_bits, bits = _task_bits(total, params.key_bytes), _task_bits(total, params.task_bytes)
    again = cut(_again(others.select("text"), key_bits, _key_bytes(total), params))
    bitmap, wide = _filter(again, key_bits, params)
    made = cut(_segments(others.select("text", "id", "key"), bitmap, wide, _common(again), bits, params))
    free(again)
    judged = cut(_judged(made, params))
    spans = _spans(made, judged, params).groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))
    gone = copies.where(F.col("n_bytes") >= params.length).select(
        "id", "key", F.array(F.lit(_ALL)).alias("spans"))
    spans = cut(spans.unionByName(gone))
    free(made, judged, copies)

    def applied(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            out: list[list] = [[], [], [], []]
            for raw, lists in zip(f.column("text").cast(pa.binary()).to_pylist(), f.column("spans").to_pylist()):
                gone = np.minimum(merged_spans(lists), len(raw)) if lists else np.empty((0, 2), np.int64)
                ends = [0, *gone[:, 1].tolist()]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*gone[:, 0].tolist(), len(raw)]))
                for col, value in zip(out, (len(raw), len(raw) - len(kept), len(gone), kept)):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [f.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (rows.join(spans, ["id", "key"], "left").select("doc_id", "text", "spans")
            .mapInArrow(applied, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
