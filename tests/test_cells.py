from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions.hashing import hash_columns, with_hashes
from tallyweave.operators import cells, estimate, lookup
from tallyweave.session import stored
from tallyweave.sources import stores
from tallyweave.spec import FLOW_KEY, SketchSpec

SPEC = SketchSpec()


def table(df, *keys):
    keys = keys or ("layer", "row", "col")
    out = {tuple(r[k] for k in keys): r["value"] for r in df.collect()}
    return {k: v for k, v in out.items() if v}


def brute_force(flows, spec, signed):
    expected = Counter()
    for r in with_hashes(flows.select(*spec.keys), spec).collect():
        for row, name in enumerate(hash_columns(spec)):
            h = r[name]
            sign = (1 if h >> spec.sign_bit & 1 else -1) if signed else 1
            expected[(0, row, h & (spec.cols - 1))] += sign
    return {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("family", ["xx", "fast", "md5", "xx_rows", "xxhash32_rows", "fasthash32_rows", "md5_rows"])
@pytest.mark.parametrize("signed", [False, True])
def test_build_matches_brute_force(skewed, family, signed):
    spec = SketchSpec(family=family, cols=128, rows=3)
    flows = skewed.filter("packet_id < 3000")
    built = cells.build(flows, spec, signed=signed)
    assert table(built) == brute_force(flows, spec, signed)
    assert table(cells.build(flows, spec, signed=signed, pre_aggregate=True)) == table(built)


def test_more_rows_with_row_seeds(skewed):
    spec = SketchSpec(family="xx_rows", rows=6, row_seeds=(1, 2, 3, 4, 5, 6))
    assert table(cells.build_count_sketch(skewed, spec)) == brute_force(skewed, spec, True)


def test_every_row_counts_every_packet(skewed):
    sums = cells.build_count_min(skewed, SPEC).groupBy("row").agg(F.sum("value").alias("s")).collect()
    assert {r.row: r.s for r in sums} == {i: 20000 for i in range(4)}
    weighted = cells.build_count_min(skewed, SPEC, weight=F.col("wire_len"))
    assert weighted.filter("row = 2").agg(F.sum("value")).first()[0] == 2_000_000


def test_only_cells_are_shuffled(skewed):
    plan = cells.build_count_min(skewed, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cell") == 1
    assert plan.count("Exchange") == 1


def test_merge_is_the_build_of_the_union(skewed):
    parts = [cells.build_count_sketch(skewed.filter(f"packet_id % 3 = {i}"), SPEC) for i in range(3)]
    assert table(cells.merge(*parts)) == table(cells.build_count_sketch(skewed, SPEC))


def test_groups_are_built_apart(skewed):
    grouped = cells.build_count_sketch(skewed, SPEC, by=("cpu",))
    for cpu in range(4):
        alone = cells.build_count_sketch(skewed.filter(f"cpu = {cpu}"), SPEC)
        assert table(grouped.filter(f"cpu = {cpu}")) == table(alone)


def test_layouts(spark, skewed):
    spec = SketchSpec(cols=64, layers=8)
    built = cells.build_count_sketch(skewed, spec, layered=True)
    dense = cells.to_dense(built, spec)
    matrices = {r.layer: np.array(r["values"]) for r in dense.collect()}
    assert sorted(matrices) == list(range(8))
    assert all(m.shape == (4, 64) for m in matrices.values())
    for (layer, row, col), value in table(built).items():
        assert matrices[layer][row, col] == value
    assert sum(int(np.abs(m).sum()) for m in matrices.values()) == sum(abs(v) for v in table(built).values())
    assert table(cells.to_long(dense)) == table(built)
    rows = cells.to_row_arrays(built, spec).collect()
    assert len(rows) == 8 * 4 and all(len(r["values"]) == 64 for r in rows)
    assert table(cells.unnumber_cells(cells.number_cells(built, spec), spec)) == table(built)
    empty = cells.to_dense(built.filter("value > 1e9"), spec).collect()
    assert len(empty) == 8 and not any(np.any(r["values"]) for r in empty)


def test_rows_are_put_together_apart(skewed):
    """A dense summary is made of one aggregate per row; groups, null ones too, have all their rows."""
    spec = SketchSpec(cols=64, layers=8)
    grouped = skewed.withColumn("cpu", F.when(F.col("cpu") > 0, F.col("cpu")))
    built = cells.build_count_sketch(grouped, spec, layered=True, by=("cpu",))
    arrays = cells.to_row_arrays(built, spec, by=("cpu",))
    found = {(r.cpu, r.layer, r.row): list(r["values"]) for r in arrays.collect()}
    assert len(found) == 4 * 8 * 4 and all(len(v) == 64 for v in found.values())
    assert sum(abs(x) for v in found.values() for x in v) == built.agg(F.sum(F.abs("value"))).first()[0]
    for r in built.collect():
        assert found[r.cpu, r.layer, r.row][r.col] == r.value
    dense = {(r.cpu, r.layer): [list(v) for v in r["values"]] for r in cells.to_dense(built, spec, by=("cpu",)).collect()}
    assert dense == {
        (cpu, layer): [found[cpu, layer, row] for row in range(4)] for cpu in (None, 1, 2, 3) for layer in range(8)
    }


def test_nested_layers(skewed):
    spec = SketchSpec(layers=6)
    deep = table(cells.build_count_sketch(skewed, spec, layered=True))
    expected = Counter()
    for (layer, row, col), value in deep.items():
        for upper in range(layer + 1):
            expected[(upper, row, col)] += value
    found = table(cells.nested(cells.build_count_sketch(skewed, spec, layered=True), spec))
    assert found == {k: v for k, v in expected.items() if v}
    # Layer 0 of the nested view is the plain summary.
    flat = table(cells.build_count_sketch(skewed, spec.with_(layers=1)))
    assert {k: v for k, v in found.items() if k[0] == 0} == flat


def test_saved_cells(spark, skewed, tmp_path):
    built = cells.build_count_min(skewed, SPEC)
    stores.write_cells(built, str(tmp_path / "c"))
    assert table(stores.read_cells(spark, str(tmp_path / "c"))) == table(built)


# Estimates ------------------------------------------------------------------------


def test_count_min_error_bound(skewed):
    counts = cells.count_keys(skewed, SPEC)
    found = estimate.estimate_min(counts, cells.build_count_min(skewed, SPEC), SPEC).collect()
    assert len(found) == counts.count()
    assert all(r.est >= r.n for r in found)
    off = sum(r.est - r.n > np.e / SPEC.cols * 20000 for r in found)
    assert off <= np.exp(-SPEC.rows) * len(found)


def test_count_sketch_finds_the_hot_key(skewed):
    counts = cells.count_keys(skewed, SPEC)
    found = estimate.estimate_median(counts, cells.build_count_sketch(skewed, SPEC), SPEC).collect()
    hot = max(found, key=lambda r: r.n)
    assert hot.n == 6667
    assert abs(hot.est - hot.n) < 0.02 * 20000
    errors = [r.est - r.n for r in found]
    assert abs(np.mean(errors)) < 10


@pytest.mark.parametrize("packed", [0, 1 << 18])
def test_probe_without_broadcast_gives_the_same(skewed, monkeypatch, packed):
    counts = cells.count_keys(skewed, SPEC)
    built = cells.build_count_sketch(skewed, SPEC)
    near = {tuple(r) for r in estimate.estimate_median(counts, built, SPEC).collect()}
    monkeypatch.setattr(estimate, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(estimate, "PACKED_CELLS", packed)
    far = estimate.estimate_median(counts, built, SPEC)
    assert {tuple(r) for r in far.collect()} == near


def test_probing_rows_are_shuffled_once_and_hot_groups_split(spark, skewed, monkeypatch):
    """Beyond the bound: raw packets of which half are in one layer, in parts of at most 3,000."""
    spec = SketchSpec(layers=3)
    built = cells.nested(cells.build_count_sketch(skewed, spec, layered=True), spec)
    hashed = with_hashes(skewed.select(*FLOW_KEY), spec).withColumn("at", F.pmod("src_ip", F.lit(3)).cast("int"))
    near = sorted(estimate.probe(hashed, built, spec, layer=F.col("at")).collect())
    monkeypatch.setattr(estimate, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(lookup, "ROWS_TOGETHER", 3000)
    far = estimate.probe(hashed, stored(built, "cells"), spec, layer=F.col("at"))
    assert sorted(far.collect()) == near
    # One merge join, so the probing rows are exchanged once.
    plan = far._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 1
    # Small partitions are put together again unless that is turned off.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = far.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert per_task < 0.9 * far.groupBy("at").count().agg(F.max("count")).first()[0]


def test_estimates_inside_groups(skewed, monkeypatch):
    """The cells of all groups are counted: within the bound and beyond it the result is the same."""
    grouped = skewed.withColumn("cpu", F.when(F.col("cpu") > 0, F.col("cpu")))  # a group of its own for null
    built = cells.build_count_min(grouped, SPEC, by=("cpu",))
    keys = cells.count_keys(grouped, SPEC, by=("cpu",))
    near = sorted(estimate.estimate_min(keys, built, SPEC, by=("cpu",)).collect(), key=str)
    assert len(near) == keys.count() and all(r.est >= r.n for r in near)
    for bound in (100, 0):
        monkeypatch.setattr(estimate, "BROADCAST_CELLS", bound)
        assert sorted(estimate.estimate_min(keys, built, SPEC, by=("cpu",)).collect(), key=str) == near


def test_unknown_key_and_empty_summary(spark, skewed):
    keys = spark.createDataFrame([(1, 2, 3, 4, 5)], "src_ip long, dst_ip long, src_port int, dst_port int, proto int")
    none = skewed.filter("packet_id < 0")
    assert estimate.estimate_min(keys, cells.build_count_min(none, SPEC), SPEC).first().est == 0
    assert estimate.estimate_median(keys, cells.build_count_sketch(none, SPEC), SPEC).first().est == 0.0


def test_text_queries(spark, skewed):
    rows = [
        ("10.0.0.1", "11.0.0.1", "6", "1234", "443"),
        ("10.0.0.1", "11.0.0", "6", "1234", "443"),
        ("10.0.0.1", "11.0.0.1", "six", "1234", "443"),
        ("10.0.0.1", "11.0.0.1", "6", "-1", "443"),
        ("10.0.0.1", "11.0.0.1", "6", "1234", "65536"),
        (None, "11.0.0.1", "6", "1234", "443"),
    ]
    texts = spark.createDataFrame(rows, "src_ip string, dst_ip string, proto string, src_port string, dst_port string")
    asked = estimate.parse_query_keys(texts)
    found = estimate.estimate_min(asked, cells.build_count_min(skewed, SPEC), SPEC).collect()
    assert len(found) == 1
    assert found[0].est >= 6667
    assert [found[0][k] for k in FLOW_KEY] == [0x0A000001, 0x0B000001, 1234, 443, 6]


def test_no_key_is_dropped_by_what_its_extra_sums_to(spark):
    """Sums that are null, negative or cancel the count leave every key in place."""
    rows = [(k, k, 1, 1, 6, w) for k, w in ((1, None), (2, 5), (3, -9), (4, -1), (5, 0))]
    flows = spark.createDataFrame(rows, "src_ip long, dst_ip long, src_port int, dst_port int, proto int, w long")
    found = cells.count_keys(flows, SketchSpec(), extra={"w": F.sum("w")})
    assert {r["src_ip"]: r["w"] for r in found.collect()} == {1: None, 2: 5, 3: -9, 4: -1, 5: 0}
