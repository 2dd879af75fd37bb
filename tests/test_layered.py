from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import cells, layered, topk
from tallyweave.operators.estimate import estimate_median
from tallyweave.spec import FLOW_KEY, SketchSpec

SPEC = SketchSpec(layers=12, heap_size=64)


@pytest.fixture(scope="module")
def heap(skewed):
    return layered.summarize(skewed, SPEC).cache()


def key_of(r):
    return tuple(r[k] for k in FLOW_KEY)


def test_lists_match_brute_force(skewed, heap):
    built = layered.build_layered(skewed, SPEC)
    keys = layered.layers_of(cells.count_keys(skewed, SPEC), SPEC)
    nested = cells.nested(built, SPEC)
    for layer in (0, 1, 5):
        flat = nested.filter(F.col("layer") == layer).withColumn("layer", F.lit(0))
        inside = keys.filter(F.col("deepest") >= layer)
        scored = estimate_median(inside, flat, SPEC.with_(layers=1), floor=True).collect()
        ranked = sorted((r for r in scored if r.est > 0), key=lambda r: (-r.est, key_of(r)))[: SPEC.heap_size]
        expected = [(i + 1, r.est, key_of(r)) for i, r in enumerate(ranked)]
        found = sorted((r["rank"], r.est, key_of(r)) for r in heap.filter(F.col("layer") == layer).collect())
        assert found == expected


def test_hot_key_leads_all_its_layers(heap):
    hot = heap.filter("layer = 0 and rank = 1").first()
    assert hot.src_port == 1234 and abs(hot.est - 6667) < 400
    leads = {r.layer for r in heap.filter("rank = 1 and src_port = 1234").collect()}
    assert leads == set(range(hot.deepest + 1))


@pytest.mark.parametrize("g, reference", [
    (layered.g_distinct, lambda x: (x > 0) - (x < 0)),
    (layered.g_l1, lambda x: x),
    (layered.g_f2, lambda x: x * x),
])
def test_gsum_equals_the_recursion(heap, g, reference):
    per_layer = defaultdict(list)
    for r in heap.collect():
        per_layer[r.layer].append(r)
    y = sum(reference(r.est) for r in per_layer[SPEC.layers - 1])
    for j in reversed(range(SPEC.layers - 1)):
        y = 2 * y + sum((1 - 2 * (r.deepest >= j + 1)) * reference(r.est) for r in per_layer[j])
    assert layered.gsum(heap, SPEC, g).first().gsum == pytest.approx(y)


def test_statistics_are_near_the_truth(skewed, heap):
    counts = [r.n for r in cells.count_keys(skewed, SPEC).collect()]
    assert layered.count_distinct(heap, SPEC).first().distinct_keys == pytest.approx(len(counts), rel=0.4)
    l1 = layered.gsum(heap, SPEC, layered.g_l1).first().gsum
    assert l1 == pytest.approx(sum(counts), rel=0.4)
    f2 = layered.gsum(heap, SPEC, layered.g_f2).first().gsum
    assert f2 == pytest.approx(sum(n * n for n in counts), rel=0.2)
    assert layered.gsum(heap, SPEC, layered.g_entropy).first().gsum > 0


def test_empty_input(skewed):
    none = layered.summarize(skewed.filter("packet_id < 0"), SPEC)
    assert none.count() == 0
    assert layered.count_distinct(none, SPEC).first().distinct_keys == 0.0


def test_keys_are_scanned_and_shuffled_once(skewed, spark, data_dir):
    from tallyweave.plans.queries import QUERIES

    df = QUERIES["heavy_hitters"](spark, data_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1
    assert "WindowGroupLimit" in final
    assert "SortMergeJoin" not in final and "CartesianProduct" not in final and "NestedLoop" not in final


@pytest.fixture(scope="module")
def rare(spark):
    """30,000 keys, most of them once; 40 of them 25 times each, so that their estimates tie or nearly do."""
    i = F.col("id")
    key = F.when(i < 29000, i).otherwise(29000 + i % 40)
    return spark.range(30000, numPartitions=6).select(
        (167772160 + key).alias("src_ip"), F.lit(184549377).cast("bigint").alias("dst_ip"), (key % 60000).cast("int").alias("src_port"),
        F.lit(443).alias("dst_port"), F.lit(6).alias("proto"),
    )


@pytest.mark.parametrize("spec", [SPEC, SketchSpec(layers=3, cols=8, heap_size=9), SketchSpec(heap_size=2000)])
def test_pruned_lists_are_the_same(rare, skewed, spec):
    for flows in (rare, skewed) if spec is SPEC else (rare,):
        expected = layered.summarize(flows, spec)
        found = layered.summarize_pruned(flows, spec)
        assert sorted(found.collect()) == sorted(expected.select(*found.columns).collect())
    assert layered.summarize_pruned(rare.limit(0), spec).count() == 0


def test_floors_prune_and_never_reach_above_the_list(rare, spark):
    """Equal estimates: a small summary gives most keys the same few values, and keys decide."""
    spec = SketchSpec(layers=4, cols=16, heap_size=20)
    nested = cells.nest_numbered(cells.number_cells(layered.build_layered(rare, spec), spec), spec)
    ends = {r["layer"]: r for r in layered.summarize(rare, spec).where("rank = 20").collect()}
    estimates = layered.estimates(rare.distinct(), nested, spec).collect()
    assert len({r.est for r in estimates}) < len(estimates) / 10
    for rate in (1, 16, 64):
        for f in layered.floors(rare, nested, spec, rate).collect():
            end = ends[f["_layer"]]
            assert (f["floor"], [-x for x in f["floor_key"]]) <= (end.est, [-x for x in key_of(end)])
            if rate == 1:
                assert f["floor"] == end.est and tuple(f["floor_key"]) == key_of(end)
    assert layered.sampling_rate(0, spec) == 1 and layered.sampling_rate(10**12, SPEC) > 10**4


def test_pruned_lists_shuffle_only_what_reaches_the_floor(rare):
    found = layered.summarize_pruned(rare, SPEC)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = final.splitlines()
    # Nothing is exchanged between the scan and the filter on the floor but what is broadcast.
    at = next(i for i, line in enumerate(lines) if "Filter" in line and "floor" in line)
    deep = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    below = [line for line in lines[at + 1 :] if deep(line) > deep(lines[at])]
    assert below and not any("Exchange hashpartitioning" in line or "SortMergeJoin" in line for line in below)
    keys = rare.distinct().count()
    survivors = layered.estimates(rare, cells.nest_numbered(cells.number_cells(layered.build_layered(rare, SPEC), SPEC), SPEC), SPEC)
    floors = {r["_layer"]: r["floor"] for r in layered.floors(rare, cells.nest_numbered(cells.number_cells(layered.build_layered(rare, SPEC), SPEC), SPEC), SPEC, 16).collect()}
    kept = survivors.where(F.col("est") >= F.element_at(F.create_map(*[F.lit(x) for p in floors.items() for x in p]), F.col("layer"))).distinct()
    assert kept.where("layer = 0").count() < keys / 10


def test_exact_merge_finds_keys_below_the_end_of_lists(spark):
    """Key 1 leads one list and is below the top of the three others; key 2 is below the top everywhere and has the largest sum."""
    spec = SketchSpec(keys=("key",), heap_size=2)
    lists = {0: {1: 50, 3: 40, 2: 39}, 1: {4: 60, 5: 55, 2: 39, 1: 30}, 2: {6: 60, 7: 55, 2: 39, 1: 31}, 3: {8: 45, 9: 44, 2: 39, 1: 29}}
    rows = [(cpu, 0, est, key, 0) for cpu, own in lists.items() for key, est in own.items()]
    parts = spark.createDataFrame(rows, "cpu int, layer int, est long, key long, deepest int")
    listed = topk.top_per_group(parts, ["cpu", "layer"], topk.heap_order(spec), 2, shard_on=spec.keys)
    assert {r["key"] for r in topk.merge_heaps(listed, spec).collect()} == {4, 6}
    found = topk.merge_exact(parts, spec, lists=("cpu",)).orderBy("rank").collect()
    assert [(r["key"], r["est"]) for r in found] == [(2, 156), (1, 140)]
    assert topk.merge_exact(parts.limit(0), spec, lists=("cpu",)).count() == 0


@pytest.mark.parametrize("k", [7, 200])
def test_exact_merge_equals_the_sum_of_everything(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_KEYS", 5)
    spec = SketchSpec(keys=("key",), heap_size=k)
    i = F.col("id")
    rows = spark.range(9000).select(
        (i % 5).alias("cpu"), (i % 3).cast("int").alias("layer"), F.when(i % 7 == 0, None).otherwise(F.floor(i / 40)).alias("key"),
        (1 + F.pmod(F.xxhash64("id"), F.lit(30))).alias("n"), F.lit(2).alias("deepest"),
    )
    parts = rows.groupBy("cpu", "layer", "key", "deepest").agg(F.sum("n").alias("est"))
    every = parts.groupBy("layer", "deepest", "key").agg(F.sum("est").alias("est"))
    expected = topk.top_per_group(every, ["layer"], topk.heap_order(spec), k, shard_on=spec.keys)
    found = topk.merge_exact(parts, spec, lists=("cpu",))
    assert sorted(found.collect(), key=str) == sorted(expected.select(*found.columns).collect(), key=str)


def test_merging_lists_adds_the_same_key(skewed, heap):
    parts = layered.summarize(skewed, SPEC, by=("cpu",))
    merged = topk.merge_heaps(parts, SPEC)
    assert merged.groupBy("layer", *FLOW_KEY).count().filter("count > 1").count() == 0
    hot = merged.filter("layer = 0 and rank = 1").first()
    own = parts.filter("layer = 0 and src_port = 1234").agg(F.sum("est")).first()[0]
    assert hot.est == own and abs(own - 6667) < 600


def test_top_k_ranges(heap):
    assert [r["rank"] for r in topk.top_k(heap, 0, 5, SPEC).collect()] == [1, 2, 3, 4, 5]
    for layer, k in ((0, 65), (12, 3), (-1, 3)):
        refused = topk.top_k(heap, layer, k, SPEC)
        assert refused.columns == heap.columns and refused.count() == 0


@pytest.mark.parametrize("k", [3, 700])
def test_ranking_in_shards_is_exact(spark, k):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100")
    try:
        rows = spark.range(5000).select((F.col("id") % 2).alias("g"), "id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
        order = [F.col("v").desc(), F.col("id").asc()]
        found = topk.top_per_group(rows, ["g"], order, k, shard_on=["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    for g in (0, 1):
        expected = sorted((r for r in rows.collect() if r.g == g), key=lambda r: (-r.v, r.id))[:k]
        got = sorted((r for r in found if r.g == g), key=lambda r: r["rank"])
        assert [r.id for r in got] == [r.id for r in expected]
        assert [r["rank"] for r in got] == list(range(1, k + 1))
