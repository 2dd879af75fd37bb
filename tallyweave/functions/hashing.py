"""Hash columns and the hash families a summary can be built on.

``xx`` families use Spark's own ``xxhash64`` and stay inside generated code; they
are the default. ``md5`` families are also JVM-side and easy to restate in SQL.
The others reproduce published byte hashes bit for bit through Arrow UDFs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import kernels, net
from tallyweave.functions.bits import U32_MASK, lane
from tallyweave.spec import FLOW_KEY, ROW_FAMILIES, SketchSpec


def _hash_binary(keys: pa.Array, kernel) -> pa.Array:
    """Apply a matrix kernel to a binary array, one call per distinct key length."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    n = len(keys)
    out = np.zeros(n, np.int64)
    valid = np.asarray(keys.is_valid())
    offset_type = np.int64 if pa.types.is_large_binary(keys.type) else np.int32
    offsets = np.frombuffer(keys.buffers()[1], offset_type)[keys.offset : keys.offset + n + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets)
    for length in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == length))
        matrix = data[starts[rows][:, None] + np.arange(length)]
        hashed = kernel(matrix)
        out[rows] = hashed.view(np.int64) if hashed.dtype == np.uint64 else hashed
    return pa.array(out, pa.int64(), mask=~valid)


def _byte_hash(kernel, parameter):
    @F.arrow_udf("bigint")
    def hashed(keys: pa.Array) -> pa.Array:
        return _hash_binary(keys, lambda matrix: kernel(matrix, parameter))

    return hashed


def fasthash64(key: Column, seed: int) -> Column:
    """64-bit pattern as a signed bigint."""
    return _byte_hash(kernels.fasthash64, seed)(key)


def fasthash32(key: Column, seed: int) -> Column:
    return _byte_hash(kernels.fasthash32, seed)(key)


def xxhash32(key: Column, seed: int) -> Column:
    return _byte_hash(kernels.xxhash32, seed)(key)


def xxhash64(key: Column, seed: int) -> Column:
    """Standard XXH64 of a binary key as a signed bigint.

    Spark's own function is this very hash for seed 42, so that seed stays native.
    """
    if seed == 42:
        return F.when(key.isNotNull(), F.xxhash64(key))
    return _byte_hash(kernels.xxhash64, seed)(key)


def jhash(key: Column, seed: int) -> Column:
    return _byte_hash(kernels.lookup3, seed)(key)


#: ``hashlittle`` of lookup3 and ``jhash`` agree on byte strings.
hashlittle = jhash


def jhash_words(words: list[Column], seed: int) -> Column:
    """The fixed-length form of jhash over one to three 32-bit words."""
    if not 1 <= len(words) <= 3:
        raise ValueError("one to three words are needed")

    @F.arrow_udf("bigint")
    def hashed(values: pa.Array) -> pa.Array:
        parts = values.flatten()
        fields = [np.asarray(f.fill_null(0)).astype(np.uint32) for f in parts]
        missing = np.logical_or.reduce([np.asarray(f.is_null()) for f in parts])
        return pa.array(kernels.lookup3_words(fields, seed).astype(np.int64), mask=missing)

    return hashed(F.struct(*[w.cast("bigint").alias(f"w{i}") for i, w in enumerate(words)]))


def murmur3_32(key: Column, seed: int) -> Column:
    return _byte_hash(kernels.murmur3_32, seed)(key)


def siphash24(key: Column, secret: bytes) -> Column:
    """SipHash-2-4 with a 16-byte secret, as a signed bigint."""
    if len(secret) != 16:
        raise ValueError("the secret must have 16 bytes")
    return _byte_hash(kernels.siphash24, secret)(key)


def siphash24_of_seed(key: Column, seed: int) -> Column:
    """SipHash-2-4 of which the secret is the seed, twice as 8 little-endian bytes."""
    return siphash24(key, seed.to_bytes(8, "little") * 2)


#: Families of byte hashes whose lanes a summary can use: function of (key, seed) and its bits.
BYTE_FAMILIES = {"jhash": (jhash, 32), "murmur3": (murmur3_32, 32), "siphash": (siphash24_of_seed, 64), "xxhash64": (xxhash64, 64)}


def xor_fold(hashes: list[Column]) -> Column:
    """XOR of several hashes of one row; 0 for none."""
    folded = F.lit(0).cast("bigint")
    for h in hashes:
        folded = folded.bitwiseXOR(h)
    return folded


def hex_number(digest: Column, first: int, digits: int) -> Column:
    """Hex digits ``first`` (from 1) onward of a text digest as a bigint."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")


def md5_u32(*parts: Column | int | str) -> list[Column]:
    """Four 32-bit values from one md5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    digest = F.md5(text)
    return [hex_number(digest, 8 * i + 1, 8) for i in range(4)]


def _nulls(keys: list[Column]) -> Column:
    """Which key columns are null, as bits of a number."""
    bits = [F.when(k.isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)]
    return reduce(lambda a, b: a + b, bits)


def _native(seed: int, keys: list[Column]) -> Column:
    """Spark's hash of a seed and the keys. It passes over nulls, so keys with nulls are told apart by where these are."""
    whole = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    return F.when(whole, F.xxhash64(F.lit(seed), *keys)).otherwise(F.xxhash64(F.lit(seed), _nulls(keys), *keys))


def _text(keys: list[Column]) -> Column:
    """Portable text of a key, with a mark for a null."""
    return net.key_text(*[F.coalesce(k.cast("string"), F.lit(r"\N")) for k in keys])


def _packed(spec: SketchSpec) -> Column:
    """The packed key. With nulls it has 14 bytes: zeros in their places, and which fields are null."""
    if tuple(spec.keys) != FLOW_KEY:
        raise ValueError(f"family {spec.family!r} hashes the packed flow key; keys must be {FLOW_KEY}")
    keys = [F.col(k) for k in spec.keys]
    filled = net.key_hex(*[F.coalesce(k, F.lit(0)) for k in keys])
    return F.coalesce(net.key_bytes(*keys), F.unhex(F.concat(filled, net.fixed_hex(_nulls(keys), 2))))


def hash_columns(spec: SketchSpec) -> list[str]:
    return [f"_h{i}" for i in range(spec.rows)]


def with_hashes(df: DataFrame, spec: SketchSpec, *, layer_hash: bool = False) -> DataFrame:
    """Add one hash column per row and, if asked, the 32-bit layer hash ``_hl``.

    The expensive hash is computed once in its own projection; the lanes are cut
    from it in the next one. Null is a value of a key like any other, apart from all others.
    """
    keys = [F.col(k) for k in spec.keys]
    family = spec.family
    if family == "xx":
        base = {"_h": _native(spec.seed, keys)}
        rows = [lane(F.col("_h"), i) for i in range(spec.rows)]
        layer = _native(spec.layer_seed, keys).bitwiseAND(F.lit(U32_MASK))
    elif family == "md5":
        df = df.withColumn("_k", F.md5(_text(keys)))
        base = {f"_p{i}": hex_number(F.col("_k"), 8 * i + 1, 8) for i in range((spec.rows + 1) // 2)}
        if layer_hash:
            base["_hl"] = hex_number(F.col("_k"), 17, 8)
        rows = [
            F.shiftright(F.col(f"_p{i // 2}"), 0 if i % 2 else 16).bitwiseAND(F.lit(0xFFFF)) for i in range(spec.rows)
        ]
        layer = F.col("_hl")
    elif family == "fast":
        base = {"_k": _packed(spec)}
        base_hash = fasthash64(F.col("_k"), spec.seed)
        layer = fasthash32(F.col("_k"), spec.layer_seed)
        df = df.withColumns(base)
        base = {"_h": base_hash} | ({"_hl": layer} if layer_hash else {})
        rows = [lane(F.col("_h"), i) for i in range(spec.rows)]
        layer = F.col("_hl")
    elif family in BYTE_FAMILIES:
        df = df.withColumn("_k", _packed(spec))
        hashed, bits = BYTE_FAMILIES[family]
        parts = 64 // bits
        seeds = (spec.seed,) if parts == 1 else spec.row_seeds[:parts]
        base = {f"_p{i}": hashed(F.col("_k"), seed) for i, seed in enumerate(seeds)}
        if layer_hash:
            base["_hl"] = hashed(F.col("_k"), spec.layer_seed).bitwiseAND(F.lit(U32_MASK))
        per = 4 // parts
        rows = [lane(F.col(f"_p{i // per}"), i % per) for i in range(spec.rows)]
        layer = F.col("_hl")
    elif family in ROW_FAMILIES:
        seeds = spec.row_seeds[: spec.rows]
        if family == "xx_rows":
            base = {}
            rows = [_native(s, keys).bitwiseAND(F.lit(U32_MASK)) for s in seeds]
            layer = _native(spec.layer_seed, keys).bitwiseAND(F.lit(U32_MASK))
        elif family == "md5_rows":
            base = {"_h": _text(keys)}
            rows = [hex_number(F.md5(F.concat(F.lit(f"{s}|"), F.col("_h"))), 1, 8) for s in seeds]
            layer = hex_number(F.md5(F.concat(F.lit(f"{spec.layer_seed}|"), F.col("_h"))), 1, 8)
        else:
            byte_hash = xxhash32 if family == "xxhash32_rows" else fasthash32
            base = {"_h": _packed(spec)}
            rows = [byte_hash(F.col("_h"), s) for s in seeds]
            layer = byte_hash(F.col("_h"), spec.layer_seed)
    if base:
        df = df.withColumns(base)
    out = dict(zip(hash_columns(spec), rows))
    if layer_hash:
        out["_hl"] = layer
    return df.withColumns(out).drop("_h", "_k", "_p0", "_p1")
