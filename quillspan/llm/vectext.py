"""Vectorised text kernels: words, n-grams and their 64-bit hashes over whole Arrow batches.

Every function works on the concatenated UTF-8 bytes of many texts at once, so
the cost per byte is a handful of numpy passes.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one numpy pass holds; bounds a worker's memory, not the length of a text.
SLICE_BYTES = 1 << 20
#: Bytes of a span from which one call a span is cheaper than numpy passes over its blocks.
LONG_SPAN = 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_PLACE = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: What is left of a 64-bit load when a span has so many bytes from there on.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes; a longer text stays whole, alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes on end, and where each begins (one more entry than texts); ``lower`` maps A-Z only."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return (_LOWER[buf] if lower else buf), offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, ``[^\\x20\\x09-\\x0D]+`` unless ``gap`` marks other bytes as none of theirs, and the index of each text's first word."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~gap[buf]
    fresh = np.zeros(len(buf) + 1, dtype=bool)
    fresh[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | fresh[1:-1]
    end[:-1] &= ~solid[1:] | fresh[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes or units.

    Short spans sum their blocks of eight bytes, each mixed with its place, and
    mix in the length; those over LONG_SPAN bytes take XXH3.
    """
    width = buf.itemsize
    data = np.concatenate([buf.view(np.uint8), np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))
    at, size = starts * width, (ends - starts) * width
    total = mix64((loads[at] & _MASK[np.minimum(size, 8)]) ^ _PLACE)
    long_ = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    if len(long_):
        more = (size[long_] - 1) // 8
        begin = np.cumsum(more) - more
        place = np.arange(1, more.sum() + 1) - np.repeat(begin, more)
        owner = np.repeat(long_, more)
        block = loads[at[owner] + 8 * place] & _MASK[np.minimum(size[owner] - 8 * place, 8)]
        salt = mix64(np.arange(place.max() + 1, dtype=np.uint64) + _PLACE)
        total[long_] += np.add.reduceat(mix64(block ^ salt[place]), begin)
    total = mix64(total ^ (size.astype(np.uint64) * _LENGTH))
    long_ = np.flatnonzero(size > LONG_SPAN)
    if len(long_):
        view = data.data
        total[long_] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at[long_].tolist(), (at + size)[long_].tolist())]
    return total


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64((left ^ _PLACE) * _STEP + right)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` hashes, by doubling; entry i covers i to i + size."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    done, out, run, have = 0, None, hashes, 1
    while True:
        if size & have:
            part = run[done : done + len(hashes) - size + 1]
            out = part if out is None else _pair(out, part)
            done += have
        if done == size:
            return mix64(out + np.uint64(size))
        run = _pair(run[:-have], run[have:])
        have *= 2


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each window of ``size`` words that lies within one text, and its text; ``first`` from word_bounds."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - before[owner] + first[:-1][owner], owner


def totals(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each text's whole sequence of word hashes, each mixed with its place, as signed 64-bit; texts without words differ from none."""
    counts = np.diff(first)
    place = (np.arange(len(hashes)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix64(mix64(hashes ^ np.uint64(seed)) ^ mix64(place + _PLACE)), out=total[1:])
    return mix64((total[first[1:]] - total[first[:-1]]) ^ (counts.astype(np.uint64) + np.uint64(1)) * _LENGTH).view(np.int64)


def distinct_within(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each owner, on end, and where each owner's begin; ``owner`` ascends."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    parts = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(n)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
