"""lookup3 (jhash) over keys of a fixed length, as projections on 64-bit numbers that hold 32-bit words.

Every step of the hash is a projection of its own: each reads the words of the step before twice, so one expression for the
whole would double with every step. Spark keeps them apart and compiles them into one stage; no Python worker is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.bits import U32_MASK
from tallyweave.functions.kernels import LOOKUP3_FINAL, LOOKUP3_MIX, LOOKUP3_START

_STATE = ("_l0", "_l1", "_l2")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(U32_MASK))


def _rotated(x: Column, r: int) -> Column:
    return _low(F.shiftleft(x, r)).bitwiseOR(F.shiftright(x, 32 - r))


def little_endian_words(key: Column, length: int) -> list[Column]:
    """The 32-bit words of a binary key; the last one may have fewer bytes."""
    words = []
    for start in range(0, length, 4):
        number = F.conv(F.hex(F.substring(key, start + 1, min(4, length - start))), 16, 10).cast("bigint")
        size = min(4, length - start)
        parts = [F.shiftleft(F.shiftright(number, 8 * (size - 1 - i)).bitwiseAND(F.lit(255)), 8 * i) for i in range(size)]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), parts))
    return words


def with_lookup3(df: DataFrame, words: list[Column], length: int, seed: int, name: str) -> DataFrame:
    """Add the hash of ``length`` bytes given as 32-bit words; null if a word is null."""
    start = (LOOKUP3_START + length + seed) & U32_MASK
    inputs = [f"_w{i}" for i in range(len(words))]
    df = df.withColumns({w: _low(word.cast("bigint")) for w, word in zip(inputs, words)} | {s: F.lit(start) for s in _STATE})
    missing = reduce(lambda a, b: a | b, [F.col(w).isNull() for w in inputs]) if inputs else F.lit(False)
    turns = max(0, (len(words) - 1) // 3)
    for turn in range(turns + 1):
        fed = inputs[3 * turn : 3 * turn + 3]
        df = df.withColumns({s: _low(F.col(s) + F.col(w)) for s, w in zip(_STATE, fed)})
        if turn < turns:
            for x, y, r in LOOKUP3_MIX:
                a, b, c = _STATE[x], _STATE[y], _STATE[3 - x - y]
                df = df.withColumn(a, _low(F.col(a) - F.col(b)).bitwiseXOR(_rotated(F.col(b), r)))
                df = df.withColumn(b, _low(F.col(b) + F.col(c)))
    if inputs:
        for x, y, r in LOOKUP3_FINAL:
            a, b = _STATE[x], _STATE[y]
            df = df.withColumn(a, _low(F.col(a).bitwiseXOR(F.col(b)) - _rotated(F.col(b), r)))
    return df.withColumn(name, F.when(~missing, F.col(_STATE[2]))).drop(*inputs, *_STATE)


def with_jhash(df: DataFrame, key: str, length: int, seed: int, name: str) -> DataFrame:
    """Add the hash of a binary column of which every value has ``length`` bytes."""
    return with_lookup3(df, little_endian_words(F.col(key), length), length, seed, name)


def with_jhash_words(df: DataFrame, words: list[Column], seed: int, name: str) -> DataFrame:
    """Add the fixed-length form over one to three 32-bit words."""
    if not 1 <= len(words) <= 3:
        raise ValueError("one to three words are needed")
    return with_lookup3(df, words, 4 * len(words), seed, name)
