from collections import Counter

import pytest

from tallyweave.functions import hashing
from tallyweave.operators import keyed, lookup
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def writes(spark):
    rows = [(i, 5 if i % 3 == 0 else i * i - 50) for i in range(300)]
    return spark.createDataFrame(rows, "seq long, x long").repartition(5), rows


def result(df):
    return {r.key: r.value for r in df.collect()}


@pytest.mark.parametrize("size", [8, 1 << 23])
def test_tables(writes, size):
    df, rows = writes
    touches = Counter(x % size for _, x in rows)
    last = {x % size: x for _, x in rows}
    assert result(keyed.increment(df, size)) == touches
    assert result(keyed.increment_after_insert(df, size)) == {k: n - 1 for k, n in touches.items()}
    assert result(keyed.last_write(df, size)) == last
    assert result(keyed.write_after_insert(df, size)) == {k: 0xFEDC if touches[k] == 1 else v for k, v in last.items()}
    assert result(keyed.write_constant(df, size)) == {k: 0xFEDC for k in touches}


@pytest.mark.parametrize("size", [16, 1 << 23])
def test_lookup(spark, writes, size):
    df, rows = writes
    table = keyed.increment(df.filter("x < 1000"), size)
    stored = result(table)
    found = {r.seq: r.value for r in keyed.lookup(df, table, size, default=-1).collect()}
    assert found == {seq: stored.get(x % size, -1) for seq, x in rows}
    bare = keyed.lookup(df, table, size).filter("value is null").count()
    assert bare == sum(1 for _, x in rows if x % size not in stored)


def test_lookup_beyond_the_bound_and_in_a_wrong_table(writes, monkeypatch):
    """The same values without a broadcast, with a hot slot in parts, and from a table with slots out of range."""
    df, _ = writes
    probes = df.withColumn("x", F.when(F.col("seq") % 3 == 0, F.lit(7)).otherwise(F.col("x")))
    table = keyed.increment(df, 64)
    near = sorted(keyed.lookup(probes, table, 64, default=0).collect())
    odd = table.union(table.select(F.col("key") + 64, F.lit(99).cast("bigint")))
    assert sorted(keyed.lookup(probes, odd, 64, default=0).collect()) == near
    monkeypatch.setattr(keyed, "BROADCAST_SLOTS", 0)
    for together in (10, 10**6):
        monkeypatch.setattr(lookup, "ROWS_TOGETHER", together)
        assert sorted(keyed.lookup(probes, odd, 64, default=0).collect()) == near


def test_checksum_ignores_order_and_sees_changes(writes):
    df, _ = writes
    row_hash = F.xxhash64("seq", "x")
    one = keyed.table_checksum(df, row_hash).first()
    assert one == keyed.table_checksum(df.orderBy(F.col("x")), row_hash).first()
    assert one != keyed.table_checksum(df.withColumn("x", F.col("x") + 1), row_hash).first()
    assert keyed.table_checksum(df.filter("seq < 0"), row_hash).first().checksum == 0


def test_xor_fold(spark):
    row = spark.range(1).select(
        hashing.xor_fold([]).alias("none"), hashing.xor_fold([F.lit(12), F.lit(10)]).alias("two")
    ).first()
    assert (row.none, row.two) == (0, 6)
