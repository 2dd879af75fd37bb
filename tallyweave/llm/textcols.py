"""Whole columns of text as numpy arrays: bytes, words and hashes of an Arrow string column.

Everything here works on one Arrow record batch inside a task. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd, so that its powers can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Bytes of text handled at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 19

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the published splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_values(fold_ascii: bool = False, seed: int = 1) -> np.ndarray:
    """One random 64-bit value per byte; with fold_ascii A-Z get the values of a-z."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(seed))
    if fold_ascii:
        values[65:91] = values[97:123]
    return values


def slices(column: pa.Array | pa.ChunkedArray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part of the column) so that each part holds about ``budget`` bytes or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.asarray(pc.binary_length(column), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, n + 1 offsets into them) of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Powers:
    """Powers of BASE and of its inverse, grown on demand and kept for the task."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def need(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = 1 << (n - 1).bit_length()
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, factor, dtype=U64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, n + 1 long: what ``span_hash`` needs to hash any span."""
    POWERS.need(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * POWERS.up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes wherever they lie."""
    POWERS.need(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * POWERS.down[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of a slice: byte spans, the row of each word, and the first word of each row (n + 1)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    firsts: np.ndarray

    def hashes(self, fold_ascii: bool = False) -> np.ndarray:
        return span_hash(prefix_hash(byte_values(fold_ascii)[self.data]), self.starts, self.ends)


def words(column: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row; a word never crosses two rows."""
    data, offsets = joined(column)
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:][(offsets[1:] > 0)] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    firsts = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(column)), np.diff(firsts))
    return Words(data, offsets, starts, ends, rows, firsts)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every window of ``width`` words that lies within one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.full(n, seed, dtype=U64)
    for k in range(width):
        total *= U64(BASE)
        total += hashes[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(total[at]), at


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points per row: bytes that do not continue a character."""
    return counts((data & 0xC0) != 0x80, offsets)


def counts(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes per row."""
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with rows only."""
    return (b for b in batches if b.num_rows)
