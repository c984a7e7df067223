"""Counts of hashes in a fixed number of cells, as a filter: what no cell counts often enough can't be frequent.

Tasks count their own hashes by cell, packed by ranges of cells into binary rows; the rows of a range meet in one
task, which keeps one bit a cell: whether its count reaches the least. A hash is never lost; one that shares a full cell is let through. The
bits are ``2^bits / 8`` bytes, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranges have 2^RANGE_BITS cells (16 at most, for the packing); their counts are added by so many tasks.
RANGE_BITS, TASKS = 16, 64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def told(bits_set: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash's cell has its bit."""
    cell = hashes >> np.uint64(64 - bits)
    return (bits_set[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def packed(cells: np.ndarray, counts: np.ndarray, per: int) -> Iterator[tuple[int, bytes]]:
    """(range, bytes) of cells' counts: each range's steps from cell to cell, low bytes, then high bytes, then the counts.

    Most high bytes are 0 and most counts 1, so what is moved is little more than a byte a cell.
    """
    value = (cells << np.uint64(8)) | counts.astype(np.uint64)
    value.sort()
    cell = value >> np.uint64(8)
    begin = np.flatnonzero(np.diff(cell, prepend=np.uint64((1 << 64) - 1)))
    if not len(begin):
        return
    total = np.minimum(np.add.reduceat(value & np.uint64(255), begin), np.uint64(255)).astype(np.uint8)
    cell = cell[begin].astype(np.int64)
    of, within = np.divmod(cell, per)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    step = np.diff(within, prepend=0)
    step[starts] = within[starts]
    planes = np.stack([(step & 255).astype(np.uint8), (step >> 8).astype(np.uint8), total])
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
        yield int(of[x]), planes[:, x:y].tobytes()


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells within their range, counts)."""
    low, high, count = data.reshape(3, -1)
    return np.cumsum(low.astype(np.int64) | high.astype(np.int64) << 8), count


def batches(hashes: np.ndarray, counts: np.ndarray, bits: int, top: int) -> Iterator[pa.RecordBatch]:
    """(range, cells) of a task's hashes and how often each occurs; counts above ``top`` (255 at most) count as that."""
    found = list(packed(hashes >> np.uint64(64 - bits), np.minimum(counts, top), 1 << min(bits, RANGE_BITS)))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["range", "cells"])


def often(rows: DataFrame, bits: int, top: int) -> np.ndarray:
    """One bit for each cell: whether ``rows`` (range, cells) count ``top`` in it."""
    per = 1 << min(bits, RANGE_BITS)

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in parts:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                cell, count = unpacked(np.frombuffer(data.as_buffer(), np.uint8))
                sums = found.setdefault(r, np.zeros(per, np.uint16))
                sums[cell] = np.minimum(sums[cell] + count, top)
        for r, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(sums >= top, bitorder="little").tobytes()])], names=["range", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.repartition(TASKS, "range").mapInArrow(added, "range int, bits binary").collect():
        out[r["range"] * per // 8 : (r["range"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    return out
