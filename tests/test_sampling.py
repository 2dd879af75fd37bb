import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import cells, estimate, sampling, sweep
from tallyweave.spec import FLOW_KEY, SketchSpec

SPEC = SketchSpec(p=0.2)


def as_dict(df):
    return {tuple(r[c] for c in df.columns if c != "value"): r["value"] for r in df.collect()}


@pytest.mark.parametrize("family", ["xx", "md5"])
def test_gates_hit_every_row_with_probability_p(skewed, family):
    spec = SPEC.with_(family=family)
    gated = sampling.with_gates(skewed, spec, "packet_id")
    rates = gated.agg(*[F.avg(g).alias(g) for g in sampling.gate_columns(spec)]).first()
    assert all(abs(x - 0.2) < 0.015 for x in rates)
    pair = gated.agg(F.avg(F.col("_g0") * F.col("_g1"))).first()[0]
    assert abs(pair - 0.04) < 0.01


def test_sampling_does_not_depend_on_partitions(skewed):
    one = as_dict(sampling.build_sampled(skewed.coalesce(1), SPEC, "packet_id"))
    many = as_dict(sampling.build_sampled(skewed.repartition(13, "src_ip"), SPEC, "packet_id"))
    assert one == many
    other = as_dict(sampling.build_sampled(skewed, SPEC.with_(sample_seed=9), "packet_id"))
    assert other != one


def test_full_probability_is_the_plain_sketch(skewed):
    spec = SketchSpec(p=1.0)
    plain = cells.build_count_sketch(skewed, spec).filter("value <> 0")
    assert as_dict(sampling.build_sampled(skewed, spec, "packet_id").filter("value <> 0")) == as_dict(plain)
    walked = sampling.build_geometric(skewed.filter("packet_id < 2000"), spec, "packet_id").filter("value <> 0")
    assert as_dict(walked) == as_dict(cells.build_count_sketch(skewed.filter("packet_id < 2000"), spec).filter("value <> 0"))


def test_counts_and_direct_build_agree(skewed):
    counts = sampling.count_sampled_keys(skewed, SPEC, "packet_id")
    via_counts = cells.unnumber_cells(sampling.build_from_counts(counts, SPEC), SPEC).filter("value <> 0")
    direct = sampling.build_sampled(skewed, SPEC, "packet_id").filter("value <> 0")
    assert as_dict(via_counts) == as_dict(direct)


def test_estimates_are_unbiased_over_seeds(skewed):
    hot = skewed.filter("src_port = 1234").select(*FLOW_KEY).distinct()
    found = []
    for seed in range(12):
        spec = SPEC.with_(sample_seed=seed)
        built = sampling.build_sampled(skewed, spec, "packet_id")
        found.append(estimate.estimate_median(hot, built, spec).first().est)
    assert abs(np.mean(found) - 6667) < 0.03 * 6667
    assert np.std(found) > 0


def test_geometric_walk(skewed):
    spec = SPEC.with_(p=0.1)
    gated = sampling.with_geometric_gates(skewed, spec, "packet_id")
    assert gated.count() == 20000
    rates = gated.agg(*[F.avg(g).alias(g) for g in sampling.gate_columns(spec)]).first()
    # Every row is sampled alike, which a carried-over walk must not break.
    assert all(abs(x - 0.1) < 0.01 for x in rates)
    blocks = skewed.select(F.floor(F.col("packet_id") / sampling.BLOCK_PACKETS).alias("block")).distinct()
    slots = sampling.geometric_slots(blocks, spec)
    assert slots.count() == slots.distinct().count()
    first = blocks.where("block < 20").select("block", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("gap"), F.lit(spec.sample_seed), "block", "idx"), 32)
    expected = set()
    at: dict[int, int] = {}
    for r in sorted(first.withColumn("draw", draw).collect(), key=lambda r: (r.block, r.idx)):
        gap = max(1, math.ceil(math.log((r.draw + 0.5) / 2**32) / math.log(0.9)))
        at[r.block] = at.get(r.block, -1) + gap
        if at[r.block] < sampling.BLOCK_PACKETS * 4:
            expected.add((r.block * sampling.BLOCK_PACKETS + at[r.block] // 4, at[r.block] % 4))
    found = {(r.ordinal, r.row) for r in slots.filter(f"ordinal < {20 * sampling.BLOCK_PACKETS}").collect()}
    assert found == expected
    hits = gated.where(f"packet_id < {20 * sampling.BLOCK_PACKETS}").collect()
    assert {(r.packet_id, k) for r in hits for k in range(4) if r[f"_g{k}"]} == expected
    # No join and no shuffle, whatever the order of the packets; negative ids have blocks too, a missing id none.
    plan = gated._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    mixed = sampling.with_geometric_gates(skewed.repartition(7, "src_ip"), spec, "packet_id")
    assert sorted(mixed.select(*gated.columns).collect()) == sorted(gated.collect())
    odd = skewed.limit(3).withColumn("packet_id", F.when(F.col("packet_id") > 0, -F.col("packet_id")))
    assert sampling.with_geometric_gates(odd, SPEC.with_(p=1.0), "packet_id").where("_g0 = 1").count() == 2


def test_draws_grow_with_the_probability(monkeypatch):
    drawn, plain = [], sampling.gap_draws
    monkeypatch.setattr(sampling, "gap_draws", lambda blocks, idx, spec: drawn.append(len(blocks)) or plain(blocks, idx, spec))
    blocks = np.arange(500)
    for family in ("xx", "md5"):
        for p in (0.01, 0.1, 0.5):
            drawn.clear()
            place, slot = sampling.walk(blocks, SketchSpec(p=p, family=family))
            assert sum(drawn) == len(place) + len(blocks)  # one more than slots, for the step over the end
            assert abs(len(place) / (500 * 256 * p) - 1) < 0.15


def test_sweep_agrees_with_single_runs(skewed):
    packets = skewed.filter("packet_id < 4000")
    ps, seeds = (0.1, 0.4, 1.0), (5, 6)
    found = sweep.sweep_estimates(packets, SketchSpec(), "packet_id", ps, seeds)
    grid = {(r.p, r.seed, r.src_ip, r.src_port): r.est for r in found.collect()}
    keys = cells.count_keys(packets, SPEC)
    assert len(grid) == keys.count() * 6
    for p in ps:
        spec = SketchSpec(p=p, sample_seed=6)
        built = sampling.build_sampled(packets, spec, "packet_id")
        for r in estimate.estimate_median(keys, built, spec).collect():
            assert grid[(p, 6, r.src_ip, r.src_port)] == pytest.approx(r.est)
    # Keys are probed once for all runs: nothing is multiplied below a join.
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(i for i, line in enumerate(lines) if "Generate" in line) < min(i for i, line in enumerate(lines) if "Join" in line)
    errors = {r.p: r for r in sweep.sweep_error(found).collect()}
    assert errors[0.1].mean_abs_error > errors[1.0].mean_abs_error
    assert errors[0.1].estimates == keys.count() * 2
