"""Whitening of embeddings by the leading components of their covariance.

Three passes give what the components need, each as sums that tasks make and Spark adds up: counts and sums of every dimension;
exact products of whole numbers, centred first by the whole part of the mean; products of the whitened values, which measure how
far their covariance is from the identity. Between them the driver holds one matrix of the dimension, never rows.
``spectrum`` finds the eigenpairs.

Entries become whole numbers, floor(scale * c) + offset, so that the covariance is exact before it is rounded once.

Defined cases: a vector that is null, or holds a null, a NaN or an infinity, is left out; so is one that is shorter than the
longest of the others, as its last entries are missing. Entries of which the whole number is beyond 2**46 count as that. Equal
vectors and repeated rows all count; an id may be null. Without rows, or if all vectors are equal, there are no components and the result is
empty. Components whose variance is zero but for rounding are not returned. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.frames import map_batches
from tallyweave.llm.spectrum import leading
from tallyweave.session import stored

#: Rows whose products are added as floating-point numbers, exactly, if entries are below ``NARROW``.
BLOCK, NARROW = 1024, 1 << 21
_LIMIT = 1 << 46
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Whole:
    """How entries become whole numbers."""

    scale: float = 64.0
    offset: int = 1_000_000


@dataclass(frozen=True)
class Whitener:
    """Fitted components. ``sums`` are exact; the columns of ``directions`` are divided by the root of their variance."""

    whole: Whole
    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    @property
    def size(self) -> int:
        return len(self.sums)

    def base(self) -> tuple[np.ndarray, list[int]]:
        """The whole part of the mean, and what is left of the sums."""
        return _base(self.n, self.sums)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values of entries that are centred by the whole part of the mean."""
        rest = np.array([r / self.n for r in self.base()[1]])
        return (centred - rest) @ self.directions


def _base(n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    return np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]


def entries(vectors: pa.Array, whole: Whole, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that can be used, their entries as whole numbers); all have ``size`` entries, or as many as the
    longest of this batch."""
    lengths = np.diff(np.asarray(vectors.offsets)) * np.asarray(vectors.is_valid())
    flat = vectors.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[starts[1:]] == bad[starts[:-1]]) & (lengths > 0)
    if size is None:
        size = int(lengths[good].max(initial=0))
    rows = np.flatnonzero(good & (lengths == size))
    chosen = values[starts[rows][:, None] + np.arange(size)] if size else np.empty((0, 0))
    scaled = np.clip(np.floor(whole.scale * chosen), -_LIMIT, _LIMIT - 2 * abs(whole.offset))
    return rows, scaled.astype(np.int64) + whole.offset


def count_and_sums(vectors: DataFrame, whole: Whole) -> tuple[int, list[int]]:
    """How many vectors can be used, and the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, size = 0, np.zeros(0, dtype=object), 0
        for batch in batches:
            rows, x = entries(batch.column(0), whole)
            if not len(rows) or x.shape[1] < size:
                continue
            if x.shape[1] > size:
                size, n, sums = x.shape[1], 0, np.zeros(x.shape[1], dtype=object)
            n += len(rows)
            sums = sums + (x >> 16).sum(axis=0).astype(object) * 65536 + (x & 65535).sum(axis=0).astype(object)
        columns = [[size] * size, list(range(size)), [n] * size, [Decimal(s) for s in sums]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["size", "i", "n", "total"])

    parts = map_batches(vectors, run, "size int, i int, n bigint, total decimal(38,0)")
    sums = stored(parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    longest = sums.agg(F.max("size")).first()[0]
    if longest is None:
        return 0, []
    found = sums.where(F.col("size") == longest).orderBy("i").collect()  # one row for each dimension
    return found[0]["n"], [int(r["total"]) for r in found]


def products(centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of products of two dimensions over some rows, as multiples of 2**32 and the rest."""
    size = centred.shape[1]
    high, low = np.zeros((2, size, size), dtype=np.int64)
    narrow = (np.abs(centred) < NARROW).all(axis=1)
    few = centred[narrow].astype(np.float64)
    for start in range(0, len(few), BLOCK):
        block = few[start : start + BLOCK]
        exact = (block.T @ block).astype(np.int64)
        high += exact >> 32
        low += exact & _LOW
    for row in centred[~narrow].astype(object):
        exact = np.outer(row, row)
        high += (exact >> 32).astype(np.int64)
        low += (exact & _LOW).astype(np.int64)
    return high, low


def covariance(vectors: DataFrame, whole: Whole, n: int, sums: list[int]) -> np.ndarray:
    """The covariance with divisor n, each entry rounded once from its exact value."""
    base, rest = _base(n, sums)
    size = len(sums)
    first, second = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((2, size, size), dtype=np.int64)
        for batch in batches:
            more = products(entries(batch.column(0), whole, size)[1] - base)
            high += more[0] + (more[1] >> 32)
            low += more[1] & _LOW
        columns = [first.astype(np.int32), second.astype(np.int32), high[first, second], low[first, second]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "high", "low"])

    parts = map_batches(vectors, run, "i int, j int, high bigint, low bigint")
    totals = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = np.zeros((size, size))
    for i, j, high, low in totals.collect():  # size * (size + 1) / 2 rows
        out[i, j] = out[j, i] = (n * ((high << 32) + low) - rest[i] * rest[j]) / (n * n)
    return out


def fit(vectors: DataFrame, components: int = 32, whole: Whole = Whole()) -> Whitener | None:
    """Components of the vectors in the only column of ``vectors``; none if there is no variance."""
    n, sums = count_and_sums(vectors, whole)
    if not n:
        return None
    matrix = covariance(vectors, whole, n, sums)
    values, directions = leading(matrix, components)
    if not len(values):
        return None
    return Whitener(whole, n, sums, values, directions / np.sqrt(values), values / np.trace(matrix))


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest entry of the covariance of all whitened vectors, less the identity."""
    k, size, whole, base = len(model.values), model.size, model.whole, model.base()[0]
    first, second = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(entries(batch.column(0), whole, size)[1] - base)
            sums += w.sum(axis=0)
            squares += w.T @ w
        pairs = [np.concatenate([first, np.full(k, -1)]), np.concatenate([second, np.arange(k)])]
        columns = [*[p.astype(np.int32) for p in pairs], np.concatenate([squares[first, second], sums])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "value"])

    means, found = np.zeros(k), np.zeros((k, k))
    totals = map_batches(vectors, run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value"))
    for i, j, value in totals.collect():  # about components**2 / 2 rows
        if i < 0:
            means[j] = value / model.n
        else:
            found[i, j] = found[j, i] = value / model.n
    return float(np.abs(found - np.outer(means, means) - np.eye(k)).max())


def _squares(centred: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """Exact sum over dimensions of (n * x - S) ** 2 for every row, as decimal numbers."""
    widest = n * int(np.abs(centred).max(initial=0)) + max(rest, default=0)
    kind = np.int64 if widest * widest * max(1, len(rest)) < 1 << 63 else object
    away = n * centred.astype(kind) - np.array(rest, dtype=kind)
    total = (away * away).sum(axis=1)
    if kind is object:
        return pa.array([Decimal(x) if x < 10**38 else None for x in total], pa.decimal128(38, 0))
    return pa.array(total).cast(pa.decimal128(38, 0))


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, whole: Whole = Whole()
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for every vector and component. ``deviation``
    is a decimal number (null from 10**38 on)."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>"
    model = fit(df.select(vector), components, whole)
    error = identity_error(df.select(vector), model) if model else 0.0
    n, k, size = (model.n, len(model.values), model.size) if model else (0, 0, 0)
    base, rest = model.base() if model else (np.zeros(0), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if model else ():
            rows, x = entries(batch.column(1), whole, size)
            if not len(rows):
                continue
            w = model.project(x - base)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(rows) + 1, k, dtype=np.int32)), pa.array(w.ravel()))
            found = [batch.column(0).take(pa.array(rows)), _squares(x - base, n, rest), lists]
            yield pa.RecordBatch.from_arrays(found, names=[key, "deviation", "whitened"])

    shares = F.array(*[F.lit(float(x)) for x in model.explained]) if model else F.array().cast("array<double>")
    rows = map_batches(df.select(key, vector), run, schema)
    return rows.select(key, "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        key,
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
