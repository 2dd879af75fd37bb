"""Best-fit packing of token pieces into sequences, by exact-complement hashing.

Lengths are whole numbers up to the sequence length, so the choice of which lengths go together
needs only their histogram (at most ``capacity`` counts). For the longest length that is left, the
gap to a full sequence is looked up in indexes of the lengths, pair sums and triple sums that
are available; a hit is applied as often as the counts allow. Without a hit, the longest length that
fits goes in and the smaller gap is looked up again. The plan is a list of patterns and how often each
is used; every pattern uses up at least one length, so the plan is bounded by the sequence length too.

Pieces then find their place in parallel: each is ranked among those of its length (salted, so that a
length that most pieces share is ranked in parts), and its rank says which copy of which pattern holds it.

Defined cases: a null text is an empty one and gives the one piece of the closing id; repeated rows are
separate documents; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.frames import map_arrow
from tallyweave.session import stored

#: Ranks of a length are counted in so many parts.
SALTS = 64
#: Ids of so many different words are kept per worker.
KEPT_WORDS = 200_000
#: A text is encoded in stretches of about so many characters.
STRETCH = 1 << 20


def tokenizer_files() -> tuple[str, str, str]:
    """(vocabulary as ranks, split pattern, tokenizer file with the added tokens) of the default tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> dict[str, int]:
    """Strings that are one id wherever they stand in a text, and are looked for before it is split into words."""
    with open(path, "rb") as file:
        found = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that take in what stands around them are not known here")
    return {t["content"]: t["id"] for t in found}


@cache
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Known(dict):
    """Ids, as little-endian 32-bit bytes, of the words met so far."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.encode(word)).tobytes()
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


@cache
def _known(path: str, pattern: str) -> _Known:
    return _Known(_encoding(path, pattern).encode_ordinary)


#: White space that a cut before a single space could tear apart.
_LOOSE = re.compile(r"\s (?:\s|\Z)|  ")


def encoder(path: str, pattern: str, added: dict[str, int]) -> Callable[[str], bytes]:
    """Text to the bytes of its ids. Added tokens divide a text, and what is between them is encoded on its own. The pattern never joins what a single space divides, and takes that space
    with the word after it; so texts are encoded word by word and known words are looked up."""
    known, whole = _known(path, pattern), _encoding(path, pattern).encode_ordinary

    def between(text: str) -> bytes:
        if _LOOSE.search(text):
            return array("I", whole(text)).tobytes()
        if len(text) <= STRETCH:
            first, *rest = text.split(" ")
            return known[first] + b"".join([known[" " + w] for w in rest])
        parts, start = [], 0
        while start < len(text):
            stop = text.find(" ", start + STRETCH)
            stop = len(text) if stop < 0 else stop
            head, *rest = text[start:stop].split(" ")
            parts.append((known[head] if not start else b"") + b"".join([known[" " + w] for w in rest]))
            start = stop
        return b"".join(parts)

    if not added:
        return between
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
    ids = {content: array("I", [i]).tobytes() for content, i in added.items()}

    def encode(text: str) -> bytes:
        parts, start = [], 0
        for met in special.finditer(text):
            parts += [between(text[start : met.start()]), ids[met[0]]]
            start = met.end()
        return b"".join([*parts, between(text[start:])]) if start else between(text)

    return encode


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of a document; only the first may be shorter."""
    total, step = len(ids) // 4, 4 * capacity
    first = (total - 1) % capacity + 1
    start, stop, piece = 0, 4 * first, 0
    while start < len(ids):
        yield piece, start // 4, (stop - start) // 4, zlib.crc32(ids[start:stop])
        start, stop, piece = stop, stop + step, piece + 1


def pieces(docs: DataFrame, capacity: int, files: tuple[str, str, str] | None = None, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    path, pattern, tokenizer = files or tokenizer_files()
    added = added_tokens(tokenizer)
    end = array("I", [closing]).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern, added)
        rows, found = [], []
        for i, text in enumerate(batch.column(1)):
            for piece in cut(encode(text.as_py() or "") + end, capacity):
                rows.append(i)
                found.append(piece)
        columns = np.array(found, dtype=np.int64).T
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], names=names
        )

    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


class Sums:
    """Which gaps the available lengths fill alone, as pairs and as triples (bit g: gap g)."""

    def __init__(self, free: np.ndarray) -> None:
        self.lengths = [int(x) for x in np.flatnonzero(free)]
        mask = (1 << len(free)) - 1
        self.one = sum(1 << x for x in self.lengths)
        self.two = self.three = 0
        for x in self.lengths:
            self.two |= self.one << x & mask
        for x in self.lengths:
            self.three |= self.two << x & mask


def complement(gap: int, free: np.ndarray, sums: Sums) -> list[int] | None:
    """One, two or three available lengths that fill the gap exactly; long ones first."""

    def pair(total: int, taken: int = 0) -> list[int] | None:
        for a in range(total - 1, (total - 1) // 2, -1):
            b = total - a
            need = Counter((a, b, taken))
            if free[a] and free[b] and all(free[x] >= n for x, n in need.items() if x):
                return [a, b]
        return None

    if sums.one >> gap & 1 and free[gap] > 0:
        return [gap]
    if sums.two >> gap & 1 and (found := pair(gap)):
        return found
    if sums.three >> gap & 1:
        for a in reversed(sums.lengths):
            if a < gap and free[a] > 0 and sums.two >> (gap - a) & 1 and (found := pair(gap - a, a)):
                return [a, *found]
    return None


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that together use ``counts`` (index: length) up."""
    capacity = len(counts) - 1
    free, out = counts.astype(np.int64).copy(), []
    sums = Sums(free > 0)
    for length in range(capacity, 0, -1):
        while free[length] > 0:
            items, gap = [length], capacity - length
            free[length] -= 1
            while gap:
                if found := complement(gap, free, sums):
                    items += found
                    free[found[0]] -= 1
                    for x in found[1:]:
                        free[x] -= 1
                    break
                fits = np.flatnonzero(free[: gap + 1] > 0)
                if not len(fits):
                    break
                items.append(int(fits[-1]))
                free[fits[-1]] -= 1
                gap -= int(fits[-1])
            used = Counter(items)
            more = min(int(free[x]) // n for x, n in used.items())
            for x, n in used.items():
                free[x] -= more * n
            out.append((items, 1 + more))
            if any(free[x] == 0 for x in used):
                sums = Sums(free > 0)
    return out


def slots(patterns: list[tuple[list[int], int]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), by rank. A rank r of row k is in sequence
    first sequence + r - first rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for items, times in patterns:
        offset = 0
        for x in items:
            found.setdefault(x, []).append((int(used[x]), sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in found.items()}


def ranked(cut_up: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add ``rank``: a number from 0 for every piece among those of its length, without gaps."""
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # At most capacity * salts rows.
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["length", "salt"])
        .withColumn("rank", F.col("place") + F.col("before"))
        .drop("salt", "place", "before")
    )


def pack(docs: DataFrame, capacity: int = 2048, files: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    cut_up = stored(pieces(docs, capacity, files), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in cut_up.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    places = slots(plan(counts), capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
        sequence, offset = np.empty_like(length), np.empty_like(length)
        for x in np.unique(length):
            rows, at = places[int(x)], np.flatnonzero(length == x)
            k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
            sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
            offset[at] = rows[k, 2]
        columns = [batch.column(i) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    rows = ranked(cut_up).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return map_arrow(rows, place, schema)
