import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.functions import hashing, kernels, lookup3, net
from tallyweave.functions.hashing import hash_columns, with_hashes
from tallyweave.operators.cells import build_count_min, deepest_layer
from tallyweave.operators.estimate import estimate_min
from tallyweave.spec import FLOW_KEY, LANE_FAMILIES, ROW_FAMILIES, SketchSpec

# src, dst, sport, dport, proto, key hex, fasthash64, lanes (col, sign), layer hash, deepest layer
GOLDEN = [
    ("192.168.0.1", "192.168.1.1", 1234, 5678, 17, "c0a80001c0a8010104d2162e11", 0x5CEF6F989A885C52,
     [(82, -1), (136, 1), (408, -1), (239, -1)], 0x95B7C483, 0),
    ("192.168.0.1", "192.168.1.2", 1234, 5679, 17, "c0a80001c0a8010204d2162f11", 0x01BB3536058350D1,
     [(209, -1), (387, -1), (310, -1), (443, -1)], 0x609E6324, 1),
    ("10.0.0.1", "10.0.0.2", 443, 50000, 6, "0a0000010a00000201bbc35006", 0x794DCBAB13E1ABCF,
     [(463, 1), (481, -1), (427, 1), (333, -1)], 0x7655EC5A, 0),
    ("0.0.0.0", "0.0.0.0", 0, 0, 6, "00000000000000000000000006", 0xA680B568F53564CF,
     [(207, -1), (309, 1), (360, 1), (128, 1)], 0x6542A368, 2),
]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, *g[:5]) for i, g in enumerate(GOLDEN)]
    texts = spark.createDataFrame(rows, "i int, src string, dst string, src_port int, dst_port int, proto int")
    return texts.withColumns({"src_ip": net.ip_to_long(F.col("src")), "dst_ip": net.ip_to_long(F.col("dst"))})


def test_packed_key(golden):
    key = net.key_bytes(*[F.col(k) for k in FLOW_KEY])
    found = {r.i: r.h for r in golden.select("i", F.lower(F.hex(key)).alias("h")).collect()}
    assert found == {i: g[5] for i, g in enumerate(GOLDEN)}


def test_fast_family_golden(golden):
    spec = SketchSpec(family="fast", layers=32)
    hashed = with_hashes(golden, spec, layer_hash=True)
    hashed = hashed.withColumn("deepest", deepest_layer(F.col("_hl"), spec))
    for r in hashed.collect():
        g = GOLDEN[r.i]
        lanes = [r[h] for h in hash_columns(spec)]
        assert [(x & 511, 1 if x >> 15 & 1 else -1) for x in lanes] == g[7]
        assert sum(x << 16 * i for i, x in enumerate(lanes)) == g[6]
        assert (r["_hl"], r.deepest) == (g[8], g[9])


def test_other_hashes_of_key_one(golden):
    key = net.key_bytes(*[F.col(k) for k in FLOW_KEY])
    seeds = (0x2D31E867, 0x6AD611C4, 0x0, 0xFFFFFFFF, 0xDEADBEEF)
    columns = [hashing.xxhash32(key, s) for s in seeds] + [
        hashing.xxhash64(key, 0x2D31E867),
        hashing.murmur3_32(key, 0x12344321),
        hashing.jhash(key, 0x12344321),
        hashing.hashlittle(key, 0x12344321),
        hashing.siphash24(key, b"deadbeeflonglong"),
        hashing.fasthash32(key, 0xDEADBEEF),
    ]
    row = golden.filter("i = 0").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert list(row) == [
        0xB761F31D, 0x5CE9B490, 0x91229057, 0x4C2501CC, 0x3EEE2043,
        signed(0x3BF23A0216F21803), 0xDB718347, 0xA5723496, 0xA5723496, signed(0xB164BCA724ABFDDC), 0x95B7C483,
    ]


def test_any_length_and_null(spark):
    keys = [bytes((i * 37 + n) & 255 for i in range(n)) for n in range(70)] + [None]
    df = spark.createDataFrame([(k,) for k in keys], "k binary").repartition(3)
    found = df.select("k", hashing.xxhash32(F.col("k"), 77).alias("a"), hashing.xxhash64(F.col("k"), 77).alias("b"),
                      hashing.xxhash64(F.col("k"), 42).alias("n")).collect()
    assert len(found) == len(keys)
    for r in found:
        if r.k is None:
            assert (r.a, r.b, r.n) == (None, None, None)
        else:
            k = bytes(r.k)
            assert r.a == xxhash.xxh32_intdigest(k, 77)
            assert r.b == signed(xxhash.xxh64_intdigest(k, 77))
            assert r.n == signed(xxhash.xxh64_intdigest(k, 42))


@pytest.mark.parametrize("family", LANE_FAMILIES + ROW_FAMILIES)
def test_null_keys_are_keys_of_their_own(spark, family):
    """All places of nulls, zeros and equal values give hashes of their own, and none is null."""
    values = [(a, b, c) for a in (None, 0, 5) for b in (None, 0, 5) for c in (None, 0, 5)]
    rows = [(a, b, c, 443, 6, i) for i, (a, b, c) in enumerate(values)]
    df = spark.createDataFrame(rows, "src_ip long, dst_ip long, src_port int, dst_port int, proto int, i int")
    spec = SketchSpec(family=family)
    hashed = with_hashes(df, spec, layer_hash=True).select("_hl", *hash_columns(spec)).collect()
    assert all(x is not None for r in hashed for x in r)
    assert len({tuple(r) for r in hashed}) == len(values)
    assert build_count_min(df, spec).where("layer is null or row is null or col is null").count() == 0
    found = estimate_min(df, build_count_min(df.where("i % 2 = 0"), spec), spec).collect()
    assert all(r["est"] >= (r["i"] + 1) % 2 for r in found) and sum(r["est"] for r in found) <= len(values) // 2 + 2


def test_native_lookup3(spark):
    keys = [bytes((i * 91 + n * 17 + k) & 255 for i in range(n)) for n in (1, 4, 11, 13, 25, 40) for k in range(5)]
    for length in sorted({len(k) for k in keys}):
        own = [k for k in keys if len(k) == length] + [None]
        df = spark.createDataFrame([(k,) for k in own], "k binary")
        found = lookup3.with_jhash(df, "k", length, 77, "h")
        matrix = np.array([list(k) for k in own[:-1]], np.uint8)
        assert [r["h"] for r in found.collect()] == [*map(int, kernels.lookup3(matrix, 77)), None]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    rows = [(1, 2, 3), (2**32 - 1, 0, 7), (None, 2, 3), (4, None, 6), (7, 8, None)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for n in (1, 2, 3):
        columns = [F.col(c) for c in "abc"[:n]]
        native = [r["h"] for r in lookup3.with_jhash_words(df, columns, 7, "h").collect()]
        assert native == [r[0] for r in df.select(hashing.jhash_words(columns, 7)).collect()]
        assert [h is None for h in native] == [None in r[:n] for r in rows]
    with pytest.raises(ValueError):
        lookup3.with_jhash_words(df, [F.col("a")] * 4, 7, "h")


def test_families_reject_foreign_keys(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        with_hashes(df, SketchSpec(keys=("id",), family="fast"))
    with_hashes(df, SketchSpec(keys=("id",), family="xx")).collect()


def test_native_hash_stays_in_generated_code(spark):
    plan = with_hashes(spark.range(5), SketchSpec(keys=("id",)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("bad", [
    {"cols": 500}, {"rows": 0}, {"rows": 5}, {"cols": 1 << 16}, {"family": "crc"}, {"layers": 33}, {"p": 0.0},
    {"heap_size": 0}, {"keys": ()},
])
def test_spec_validation(bad):
    with pytest.raises(ValueError):
        SketchSpec(**bad)
