"""Numpy kernels over whole Arrow columns of text: words, word hashes, window hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D.  The kernels work on the
UTF-8 bytes of a batch at once; a batch is cut at document borders into segments of a few
megabytes, so that memory follows the segment (or the longest document), not the batch.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 256
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: a bijection whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def segments(column: pa.Array | pa.ChunkedArray, size: int = SEGMENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each row the number of its first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    here, before, after = inside[1:-1], inside[:-2], inside[2:]
    starts = np.flatnonzero(here & (~before | first[:-1]))
    ends = np.flatnonzero(here & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    h = lengths.astype(np.uint64) * _A
    todo, at = np.arange(len(starts)), 0
    while len(todo) and at < _LONG:
        left = np.minimum(lengths[todo] - at, 8)
        lane = lanes[starts[todo] + at] & _MASK[left]
        h[todo] = mix((h[todo] ^ lane) + _A)
        at += 8
        todo = todo[lengths[todo] > at]
    for i in np.flatnonzero(lengths > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hashes(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes, by a rolling polynomial."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (int(_A) * (2 * seed + 1) + 2 * seed * 0x51ED27) % (1 << 64) | 1
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    return mix((total[size:] - total[:n]) * powers(inverse, n) + _A)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 4 << 20:
            _POWERS[base] = have
    return have[:n]


def whole_windows(firsts: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of ``n`` window positions) whose window lies within one row, and those rows."""
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts)[:n]
    left = firsts[1:][rows] - np.arange(len(rows))
    good = np.flatnonzero(left >= size)
    return good, rows[good]


def freeing(run):
    """A task function that, when it is through, gives what it used back to the system.

    Python workers serve one task after another; without this they keep the largest one's memory.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
