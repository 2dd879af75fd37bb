import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ordered, rates

START = dt.datetime(2024, 1, 1)


DAY = 86400


def series(spark, values, name="delta", step=1):
    rows = [(START + dt.timedelta(seconds=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ts timestamp_ntz, {name} bigint").repartition(4)


@pytest.mark.parametrize("history", [[7], [7, 3], [9, 8, 1], [9, 2, 3], [50, 40, 3, 9, 4], [50, 40, 3, 9, 4, 60, 1]])
def test_rates_of_short_series(spark, history):
    deltas = series(spark, history)
    rest = history[1:]
    expected = round(sum(rest) / len(rest), 2) if rest else None
    assert rates.average_rate(deltas).first().avg_rate == expected
    assert rates.peak_rate(deltas).first().peak_rate == max(history[2:] + history[-2:])


def test_long_series_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(rates, "CHUNK_SAMPLES", 7)
    values = [(i * 37) % 11 for i in range(100)]
    deltas = series(spark, values, step=DAY)
    assert rates.peak_rate(deltas, DAY).first().peak_rate == max(values[2:])
    flat = rates.snapshots(deltas.withColumnRenamed("delta", "packets"), DAY)
    totals = [r.packets for r in flat.orderBy("ts").collect()]
    running, expected = 0, []
    for v in values:
        running += v
        expected.append(running)
    assert totals == expected
    back = rates.counter_deltas(flat, "packets", DAY).orderBy("ts").collect()
    # Samples before the first packet emit nothing.
    first = next(i for i, v in enumerate(expected) if v > 0)
    assert [r.delta for r in back] == [expected[first]] + values[first + 1 :]
    kept = rates.discard_warm_up(deltas, 2, DAY).orderBy("ts").collect()
    assert [r.delta for r in kept] == values[2:]
    assert rates.bounded(deltas, 10, DAY).count() == 10


def test_neighbours_cross_empty_chunks_and_groups(spark):
    rows = [("a", 1, 10), ("a", 2, 20), ("a", 35, 30), ("b", 4, 40), (None, 5, 50), (None, 90, 60)]
    df = spark.createDataFrame(rows, "g string, t int, v int")
    chunk = F.floor(F.col("t") / 10)
    back = ordered.neighbour(df, ["g"], "t", chunk, {"p": "v"}).collect()
    assert {(r.g, r.t): r.p for r in back} == {
        ("a", 1): None, ("a", 2): 10, ("a", 35): 20, ("b", 4): None, (None, 5): None, (None, 90): 50,
    }
    ahead = ordered.neighbour(df, ["g"], "t", chunk, {"n": "v"}, ahead=True).collect()
    assert {(r.g, r.t): r.n for r in ahead} == {
        ("a", 1): 20, ("a", 2): 30, ("a", 35): None, ("b", 4): None, (None, 5): 60, (None, 90): None,
    }


def test_neighbour_keeps_null_values_apart_from_missing_ones(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (14, 8)], "t int, v int")
    found = ordered.neighbour(df, [], "t", F.floor(F.col("t") / 10), {"p": "v"}).collect()
    assert {r.t: r.p for r in found} == {1: None, 2: 5, 3: None, 14: 7}


def test_intervals_fill_holes(spark, skewed):
    holes = skewed.filter("packet_id < 100 or packet_id between 500 and 519").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    filled = rates.per_interval(holes, 1).orderBy("ts").collect()
    assert [r.packets for r in filled] == [10] * 10 + [0] * 40 + [10] * 2
    assert sum(r.bytes for r in filled) == 120 * 100
    bare = rates.per_interval(holes, 1, fill=False, bytes=False)
    assert bare.columns == ["ts", "packets"] and bare.count() == 12
    averages = rates.average_rate(rates.interval_deltas(rates.per_interval(holes, 1))).first()
    assert averages.avg_rate == round(110 / 51, 2)


def test_totals_and_protocols(skewed):
    assert tuple(rates.totals(skewed).first()) == (20000, 2_000_000)
    assert [tuple(r) for r in rates.per_protocol(skewed).collect()] == [(6, 20000)]


def test_counters_can_be_turned_off(skewed):
    assert rates.totals(skewed, by=("proto",), bytes=False).columns == ["proto", "packets"]
    assert rates.totals(skewed, by=("proto",), packets=False).columns == ["proto", "bytes"]
    nothing = rates.totals(skewed, by=("cpu",), packets=False, bytes=False)
    assert nothing.columns == ["cpu"] and nothing.count() == 4
    with pytest.raises(ValueError):
        rates.per_interval(skewed, 60, packets=False, bytes=False)
