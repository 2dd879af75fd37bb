"""Context-triggered piecewise hashing of whole texts.

A rolling hash of the last seven bytes places boundaries where it meets a value that one byte in
``block size`` meets on average; each chunk between boundaries gives one character. A fingerprint is the block
size and the signatures at it and at twice of it. Block sizes are 3 * 2**k, so boundaries at one are
boundaries at all smaller ones too, and one pass over the bytes finds them all. Two fingerprints are compared by
the edit distance of the signatures at a block size both have.

Each text is also compared with the next one's and with its own edited text, whose second half comes from the next
document. The order of ids is cut into ranges; texts move once, to their range, where they are sorted and streamed.
The first document of a range is also sent to the range before it.

Defined cases: a null text is an empty one; an empty text has the fingerprint ``3::``; a null id comes first; rows
with one id are taken in the order of a hash of their texts, and all lie in one range; with one document it is its own
next; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textcols

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
SIGNATURE, WINDOW, SMALLEST = 64, 7, 3
#: Bytes of text that are paired and fingerprinted together.
GROUP_BYTES = 1 << 20


def rolling_levels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per byte, the largest 2**k such that a chunk ends there at block size 3 * 2**k; 0 where none ends."""
    n = len(data)
    values = (textcols.byte_values(seed=11) >> np.uint64(32)).astype(np.uint32)[data]
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    total = values.copy()
    factor = 1
    for k in range(1, WINDOW):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        total[k:] += np.where(place[k:] >= k, values[:-k] if k < n else values[:0], 0).astype(np.uint32) * np.uint32(factor)
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    total >>= np.uint32(1)
    total += np.uint32(1)
    third, rest = np.divmod(total, np.uint32(3))
    return np.where(rest == 0, third & (~third + np.uint32(1)), np.uint32(0))


def signature(prefix: np.ndarray, start: int, stop: int, ends: np.ndarray, most: int) -> bytes:
    """Letters of the chunks of [start, stop) that end at ``ends``; the last of ``most`` takes all the rest."""
    ends = ends[: most - 1]
    cuts = np.concatenate([[start], ends, [stop]]) if not len(ends) or ends[-1] < stop else np.concatenate([[start], ends])
    if cuts[-1] == cuts[0]:
        return b""
    hashes = textcols.span_hash(prefix, cuts[:-1], cuts[1:])
    return LETTERS[(hashes >> np.uint64(58)).astype(np.int64)].tobytes()


@dataclass
class Prints:
    """Fingerprints of several texts: block size as 3 * 2**level, and the two signatures."""

    level: np.ndarray
    one: list[bytes]
    two: list[bytes]

    def take(self, rows: Iterable[int]) -> Prints:
        rows = list(rows)
        return Prints(self.level[rows], [self.one[i] for i in rows], [self.two[i] for i in rows])

    def text(self) -> list[str]:
        return [f"{SMALLEST << int(k)}:{a.decode()}:{b.decode()}" for k, a, b in zip(self.level, self.one, self.two)]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> Prints:
    found = Prints(np.zeros(len(offsets) - 1, dtype=np.int64), [], [])
    levels = rolling_levels(data, offsets)
    prefix = textcols.prefix_hash(textcols.byte_values(seed=12)[data])
    for i in range(len(offsets) - 1):
        start, stop = int(offsets[i]), int(offsets[i + 1])
        k = 0
        while (SMALLEST << k) * SIGNATURE < stop - start:
            k += 1
        ends = np.flatnonzero(levels[start:stop])
        mine = levels[start:stop][ends]
        ends = ends + start + 1
        # Smaller blocks for texts whose bytes seldom meet the boundary.
        while k and np.count_nonzero(mine >= 1 << k) < SIGNATURE // 2 - 1:
            k -= 1
        found.level[i] = k
        found.one.append(signature(prefix, start, stop, ends[mine >= 1 << k], SIGNATURE))
        found.two.append(signature(prefix, start, stop, ends[mine >= 2 << k], SIGNATURE // 2))
    return found


def _matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), SIGNATURE), dtype=np.uint8)
    if len(texts):
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        rows = np.repeat(np.arange(len(texts)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Levenshtein distances of pairs of at most 64 letters, by bit-parallel columns over all pairs at once."""
    a, m = _matrix(left)
    b, n = _matrix(right)
    one = np.uint64(1)
    match = np.zeros((len(left), 128), dtype=np.uint64)
    for k in range(SIGNATURE):
        rows = np.flatnonzero(m > k)
        match[rows, a[rows, k]] |= one << np.uint64(k)
    score = m.copy()
    top = one << np.maximum(m - 1, 0).astype(np.uint64)
    up = np.full(len(left), ~np.uint64(0))
    down = np.zeros(len(left), dtype=np.uint64)
    for k in range(SIGNATURE):
        rows = np.flatnonzero((n > k) & (m > 0))
        if not len(rows):
            break
        eq, pv, mv = match[rows, b[rows, k]], up[rows], down[rows]
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[rows] += ((ph & top[rows]) != 0).astype(np.int64) - ((mh & top[rows]) != 0)
        ph, mh = ph << one | one, mh << one
        up[rows], down[rows] = mh | ~(xv | ph), ph & xv
    return np.where(m == 0, n, score)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """1 for equal fingerprints, down to 0; 0 where no block size is common."""
    apart = b.level - a.level
    best = np.zeros(len(apart))

    def compare(rows: np.ndarray, left: list[bytes], right: list[bytes]) -> None:
        if len(rows):
            x, y = [left[i] for i in rows], [right[i] for i in rows]
            longest = np.array([max(len(p), len(q), 1) for p, q in zip(x, y)])
            best[rows] = np.maximum(best[rows], 1 - edit_distances(x, y) / longest)

    level = np.flatnonzero(apart == 0)
    compare(level, a.one, b.one)
    compare(level[[bool(a.two[i] or b.two[i]) for i in level]] if len(level) else level, a.two, b.two)
    compare(np.flatnonzero(apart == 1), a.two, b.one)
    compare(np.flatnonzero(apart == -1), a.one, b.two)
    return best


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions of code points, closed by the end; first code point of each row, n + 1)."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    return np.append(heads, len(data)), np.searchsorted(heads, offsets)


def _join(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in own], dtype=np.int64)
    return np.frombuffer(b"".join(own), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_neighbours(ids: list, own: list[bytes], following: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
    """The result rows of consecutive documents: ``own[i]`` is followed by ``following[i]``."""
    data, offsets = _join(own)
    next_data, next_offsets = _join(following)
    at, first = _places(data, offsets)
    next_at, next_first = _places(next_data, next_offsets)
    chars, next_chars = np.diff(first), np.diff(next_first)
    half = chars // 2
    keep = at[first[:-1] + chars - half]
    take = next_at[next_first[:-1] + np.minimum(half, next_chars)]
    edited = [
        own[i][: keep[i] - offsets[i]] + following[i][: take[i] - next_offsets[i]] if half[i] else own[i]
        for i in range(len(own))
    ]
    # Nearly every next document is the next of ``own`` and needs no second pass.
    inside = [i + 1 < len(own) and following[i] is own[i + 1] for i in range(len(own))]
    others = iter(range(len(own), 2 * len(own)))
    follower = [i + 1 if inside[i] else next(others) for i in range(len(own))]
    every = fingerprints(*_join(own + [following[i] for i in range(len(own)) if not inside[i]]))
    prints, next_prints = every.take(range(len(own))), every.take(follower)
    edited_prints = fingerprints(*_join(edited))
    columns = [
        pa.array(ids, id_type),
        pa.array(chars, pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
        pa.array(prints.text()),
        pa.array(edited_prints.text()),
        pa.array(likeness(prints, edited_prints)),
        pa.array(likeness(prints, next_prints)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def in_ranges(docs: DataFrame) -> DataFrame:
    """(part, guard, doc_id, text): documents with their range of ids, sorted in partitions of whole ranges. A guard
    row is the first document of the next range; the very first one guards the last range."""
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)])).first()[0] if parts > 1 else None
    bounds = sorted(set(cuts or []))  # fewer than there are partitions
    kind = docs.schema["doc_id"].dataType
    if bounds:
        limits = F.array(*[F.lit(b).cast(kind) for b in bounds])
        part = F.size(F.filter(limits, lambda bound: bound <= F.col("doc_id")))
    else:
        part = F.lit(0)
    placed = docs.select(part.alias("part"), "doc_id", "text")
    firsts = placed.groupBy("part").agg(F.min(F.struct("doc_id")).alias("f")).collect()  # one row per range
    firsts = sorted((r["part"], r["f"]["doc_id"]) for r in firsts) if firsts else []
    order = [p for p, _ in firsts]
    guards = [(first, order[i - 1]) for i, (_, first) in enumerate(firsts)]
    guard = spark.createDataFrame(guards, f"first {kind.simpleString()}, before int")
    joined = placed.join(F.broadcast(guard), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guard"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(1).alias("guard"))
    sent = joined.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead))))
    return (
        sent.select("to.part", "to.guard", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartition(parts, "part")
        .sortWithinPartitions("part", "guard", "doc_id", "tie")
    )


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """One row per document: NAMES."""
    rows = in_ranges(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document that waits for the next one
        ids, own, following, size, kind = [], [], [], 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            columns = [batch.column(i) for i in range(3)]
            texts = batch.column(3).cast(pa.large_binary()) if batch.num_rows else []
            for i in range(batch.num_rows):
                part, guard, doc, text = columns[0][i].as_py(), columns[1][i].as_py(), columns[2][i].as_py(), texts[i].as_py()
                if held is not None and held[0] == part:
                    ids.append(held[1])
                    own.append(held[2])
                    following.append(text)
                    size += len(held[2])
                held = None if guard else (part, doc, text)
                if size >= GROUP_BYTES:
                    yield compare_neighbours(ids, own, following, kind)
                    ids, own, following, size = [], [], [], 0
        if ids:
            yield compare_neighbours(ids, own, following, kind)

    schema = (
        f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return rows.mapInArrow(run, schema)
