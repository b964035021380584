"""Hashes of words and shingles over whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# an odd base and its inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step
        done += take
    return out


# powers up to here are kept; texts are hashed in blocks of half as many bytes
_KEPT = 1 << 18
_UP, _DOWN = _powers(_BASE, _KEPT), _powers(_INVERSE, _KEPT)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes: `prefix[i]` covers data[:i]."""
    up = _UP if len(data) < _KEPT else _powers(_BASE, len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTES[data] * up[:len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans data[start:end], equal for equal bytes wherever they stand."""
    down = _DOWN if len(prefix) <= _KEPT else _powers(_INVERSE, len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashes_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans, block by block, so that sums and powers stay short."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + _KEPT // 2)), lo + 1)
        base = starts[lo]
        out[lo:hi] = span_hashes(prefix_sums(data[base:ends[hi - 1]]), starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words_of(texts: list[bytes], *, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]].

    Words are runs of bytes other than space and 0x09-0x0D.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = lower_ascii(data)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    return hashes_of_spans(data, starts, ends), np.searchsorted(starts, begins)


def shingles_of(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Shingle hashes of each text of `words_of`, in order and with repeats.

    A text with fewer than `size` words is one shingle, a text without words has none.
    """
    def chained(w: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(len(w) - size + 1, 0), np.uint64)
        for k in range(size):  # the place in the shingle counts
            out = mixed(out * _MIX1 + w[k:k + len(out)])
        return out

    every = chained(words, size)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        n = hi - lo
        out.append(every[lo:hi - size + 1] if n >= size else chained(words[lo:hi], n) if n else words[lo:lo])
    return out


def batches(rows: list, lengths: list[int], limit: int = 4 << 20):
    """Runs of row numbers whose lengths add up to about `limit`, one long row at least."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield range(start, i)
            start, held = i, 0
        held += n
    if start < len(rows):
        yield range(start, len(rows))
