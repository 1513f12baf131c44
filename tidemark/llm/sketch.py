"""Count-min sketches built by partitions, merged by Spark, and read as a bitmap of busy cells.

A sketch has two rows of ``2 ** width`` counters.  A partition counts in memory and gives away
only its cells that are not zero, by blocks of 65,536; blocks of equal number are added up.
Counts can only be too large.  What readers need of the sum is which cells reached a limit: one
bit a cell, 2 ** (width - 2) bytes in all, fixed by ``width`` whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 16
ROWS = 2
CELLS = "block int, cells binary, counts binary"


def width_for(amount: int, least: int = 16, most: int = 26) -> int:
    """A width with two cells a row or more for each of ``amount`` things, within bounds."""
    return min(most, max(least, (2 * max(amount, 1)).bit_length()))


def slots(h: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The cell of each hash in each row, rows one after the other."""
    other = (h * np.uint64(0xD6E8FEB86659FD93)) ^ (h >> np.uint64(32))
    return tuple((x >> np.uint64(64 - width)).astype(np.int64) + (k << width) for k, x in enumerate((h, other * np.uint64(0x9E3779B97F4A7C15))))


class Counter:
    """One partition's sketch, a byte a cell; its counts stop at 255."""

    def __init__(self, width: int):
        self.width = width
        self.cells = np.zeros(ROWS << width, np.uint8)

    def add(self, h: np.ndarray) -> None:
        for at in slots(h, self.width):
            cell, n = np.unique(at, return_counts=True)
            self.cells[cell] = np.minimum(self.cells[cell] + n, 255)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.cells), BLOCK):
            part = self.cells[start : start + BLOCK]
            used = np.flatnonzero(part)
            if len(used):
                cells, counts = used.astype("<u2").tobytes(), part[used].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start // BLOCK], pa.int32()), pa.array([cells], pa.binary()), pa.array([counts], pa.binary())], ["block", "cells", "counts"]
                )


def busy(blocks: DataFrame, width: int, limits: tuple[int, ...]) -> list[np.ndarray]:
    """For each limit, the bits of cells whose merged count reaches it.

    ``blocks`` has columns as ``CELLS``.  Blocks with equal number meet in a task as sorted rows,
    added one at a time; what reaches the driver is bounded by ``width`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)

        def bits() -> pa.RecordBatch:
            raw = [np.packbits(total >= limit).tobytes() for limit in limits]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([raw], pa.list_(pa.binary()))], ["block", "bits"])

        for batch in batches:
            for block, cells, counts in zip(*(batch[c].to_pylist() for c in ("block", "cells", "counts")), strict=True):
                if block != now:
                    if now is not None:
                        yield bits()
                    now, total[:] = block, 0
                total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, np.uint8)
        if now is not None:
            yield bits()

    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits array<binary>")
    out = [np.zeros((ROWS << width) // 8, np.uint8) for _ in limits]
    for row in merged.toLocalIterator():
        for bits, raw in zip(out, row["bits"], strict=True):
            part = np.frombuffer(bytes(raw), np.uint8)
            end = min(len(bits), row["block"] * (BLOCK // 8) + len(part))
            bits[row["block"] * (BLOCK // 8) : end] = part[: end - row["block"] * (BLOCK // 8)]
    return out


def reaches(h: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Whether the estimate of each hash (its least cell) reaches the limit of ``bits``."""
    out = np.ones(len(h), bool)
    for at in slots(h, width):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
