import ipaddress

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import bits, net, numeric

WORDS = [0, 1, 2, 3, 0x80000000, 0xFFFFFFFF, 0xFFFFFFFE, 0xF0000001, 0x7FFFFFFF, 0x00010000, 0xDEADBEEF]


def test_bits(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w bigint")
    rows = df.select(
        "w",
        bits.trailing_zeros(F.col("w")).alias("tz"),
        bits.leading_ones(F.col("w")).alias("lo"),
        bits.bits_msb_first(F.col("w")).alias("msb"),
        bits.clear_bits_lsb_first(F.col("w")).alias("clear"),
    ).collect()
    for r in rows:
        text = format(r.w, "032b")
        assert r.tz == (len(text) - len(text.rstrip("0")) if r.w else 0)
        assert r.lo == len(text) - len(text.lstrip("1"))
        assert r.msb == [int(c) for c in text]
        assert r.clear == [1 - int(c) for c in reversed(text)]


def test_floor_mean_and_medians(spark):
    values = [(-3, 4, 9, 1, 7), (5, 5, 5, 5, 5), (-10, -11, 3, 0, 2), (2**31 - 1, 2**31 - 2, 0, 0, 0)]
    df = spark.createDataFrame(values, "a int, b int, c int, d int, e int")
    cols = [F.col(c) for c in "abcde"]
    rows = df.select(
        *cols,
        bits.floor_mean(cols[0], cols[1]).alias("mean"),
        numeric.median(cols).alias("odd"),
        numeric.median(cols[:4]).alias("even"),
        numeric.median_of_five(*cols).alias("five"),
    ).collect()
    for r in rows:
        v = [r.a, r.b, r.c, r.d, r.e]
        assert r["mean"] == (r.a + r.b) // 2
        assert r.odd == r.five == sorted(v)[2]
        assert r.even == sum(sorted(v[:4])[1:3]) / 2


@pytest.mark.parametrize("text", [
    "0.0.0.0", "255.255.255.255", "10.1.2.3", "256.0.0.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "a.b.c.d", "", "1.2.3.-4",
    "1.2.3.4 ",
])
def test_ip_text(spark, text):
    try:
        expected = int(ipaddress.IPv4Address(text))
    except ValueError:
        expected = None
    df = spark.createDataFrame([(text,)], "t string").select(net.ip_to_long(F.col("t")).alias("v"))
    df = df.withColumn("back", net.long_to_ip(F.col("v")))
    row = df.first()
    assert row.v == expected
    if expected is not None:
        assert row.back == text


def test_round_half_even_and_units(spark):
    row = spark.range(1).select(
        numeric.round2(F.lit(2.125)).alias("a"), numeric.round2(F.lit(2.375)).alias("b"), numeric.gbps(F.lit(1e9)).alias("g")
    ).first()
    assert (row.a, row.b, row.g) == (2.12, 2.38, 8.0)


def test_geometric_has_the_right_law(spark):
    p = 0.3
    u = numeric.uniform_open(F.shiftrightunsigned(F.xxhash64("id"), 32))
    row = spark.range(100000).select(numeric.geometric(u, p).alias("g")).agg(
        F.min("g").alias("low"), F.avg("g").alias("mean"), F.avg((F.col("g") == 1).cast("int")).alias("ones")
    ).first()
    assert row.low == 1
    assert abs(row["mean"] - 1 / p) < 0.05
    assert abs(row.ones - p) < 0.01
    assert spark.range(3).select(numeric.geometric(u, 1.0).alias("g")).distinct().first().g == 1
