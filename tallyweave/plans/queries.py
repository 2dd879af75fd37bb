"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import bits, hashing, lookup3, net, numeric
from tallyweave.functions.hashing import hash_columns, md5_u32, with_hashes
from tallyweave.operators import cells, estimate, keyed, layered, rates, sampling, sweep, topk
from tallyweave.session import fresh_path, stored
from tallyweave.sources import flows as flow_tables
from tallyweave.sources import frames, schemas, stores
from tallyweave.spec import DEFAULT_LAYER_SEED, DEFAULT_SEED, FLOW_KEY, SketchSpec
from tallyweave.streaming import summaries
from tallyweave.streaming.tables import FoldedTable, VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPEC = SketchSpec()
MD5 = SketchSpec(family="md5")
MD5_ROWS = SketchSpec(family="md5_rows")
#: Layers and list size as needed for counting distinct flows.
LAYERED = SketchSpec(layers=16, heap_size=64)
SAMPLED = SketchSpec(p=0.25)
HOUR = 3600
SLOTS = 64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def ev(spark: SparkSession, directory: str) -> DataFrame:
    return flow_tables.flows_from_events(flow_tables.read_table(spark, directory, "events"))


def li(spark: SparkSession, directory: str) -> DataFrame:
    return flow_tables.flows_from_lineitem(flow_tables.read_table(spark, directory, "lineitem"))


def ev_counted(spark: SparkSession, directory: str) -> DataFrame:
    return flow_tables.counted(ev(spark, directory))


def li_counted(spark: SparkSession, directory: str) -> DataFrame:
    return flow_tables.counted(li(spark, directory))


def _key(*_: object) -> list[Column]:
    return [F.col(k) for k in FLOW_KEY]


# Flow rows ---------------------------------------------------------------------


@query
def flow_projection(spark, d):
    return ev(spark, d)


@query
def flow_projection_lineitem(spark, d):
    return li(spark, d)


@query
def verdicts(spark, d):
    judged = ev(spark, d).withColumn("action", flow_tables.final_action(F.col("verdict"), "REDIRECT"))
    return rates.totals(judged, by=("verdict", "action"))


@query
def ip_text_roundtrip(spark, d):
    texts = ev(spark, d).select(
        "packet_id",
        net.long_to_ip(F.col("src_ip")).alias("src_text"),
        net.long_to_ip(F.col("dst_ip")).alias("dst_text"),
    )
    return texts.withColumns(
        {"src_ip": net.ip_to_long(F.col("src_text")), "dst_ip": net.ip_to_long(F.col("dst_text"))}
    )


@query
def key_pack13(spark, d):
    return ev(spark, d).select("packet_id", F.lower(F.hex(net.key_bytes(*_key()))).alias("key_hex"))


@query
def frame_roundtrip(spark, d):
    """Frames with 0-3 tags, foreign EtherTypes and cut ends, decoded again."""
    packets = ev(spark, d)
    i = F.col("packet_id")
    depth = F.pmod(i, F.lit(4)).cast("int")
    payload = F.when(F.col("proto") == 6, 20).otherwise(8)
    size = 14 + 4 * depth + 20 + payload
    ether = F.when(i % 5 == 3, 0x0806).when(i % 5 == 4, 0x86DD).otherwise(0x0800)
    kind = F.pmod(i, F.lit(8))
    cut = (
        F.when(kind == 4, F.lit(1))
        .when(kind == 5, payload + 1)
        .when(kind == 6, payload + 21)
        .when(kind == 7, size - 10)
        .otherwise(F.lit(0))
    ).cast("int")
    framed = frames.encode_frames(packets, vlan_depth=depth, ether_type=ether, cut=cut)
    return frames.decode_frames(framed.select("packet_id", "frame")).select(
        "packet_id", "vlan_depth", "verdict", *FLOW_KEY, F.col("wire_len").cast("int").alias("wire_len")
    )


@query
def synthetic_packets(spark, d):
    ordinals = flow_tables.read_table(spark, d, "events").select("event_id")
    return flow_tables.synthetic_packets(ordinals, "event_id")


# Hashes --------------------------------------------------------------------------


@query
def hash_lanes_md5(spark, d):
    hashed = with_hashes(ev(spark, d).select("packet_id", *FLOW_KEY), MD5)
    placed = {
        name: column
        for r, h in enumerate(hash_columns(MD5))
        for name, column in (
            (f"col{r}", bits.column_index(F.col(h), MD5.cols)),
            (f"sign{r}", bits.sign(F.col(h), MD5.sign_bit)),
        )
    }
    return hashed.select("packet_id", *[c.alias(n) for n, c in placed.items()])


def _byte_hash_query(name: str, column: Callable[[Column], Column]) -> None:
    def run(spark, d):
        packed = ev(spark, d).select("packet_id", net.key_bytes(*_key()).alias("key"))
        return packed.select("packet_id", column(F.col("key")).alias("h"))

    QUERIES[name] = run


_byte_hash_query("hash_fasthash64", lambda k: hashing.fasthash64(k, DEFAULT_SEED))
_byte_hash_query("hash_fasthash32", lambda k: hashing.fasthash32(k, DEFAULT_LAYER_SEED))
_byte_hash_query("hash_xxhash32", lambda k: hashing.xxhash32(k, DEFAULT_SEED))
_byte_hash_query("hash_xxhash64", lambda k: hashing.xxhash64(k, DEFAULT_SEED))
_byte_hash_query("hash_xxhash64_native", lambda k: hashing.xxhash64(k, 42))
_byte_hash_query("hash_murmur3", lambda k: hashing.murmur3_32(k, 0x12344321))
_byte_hash_query("hash_siphash", lambda k: hashing.siphash24(k, b"deadbeeflonglong"))


@query
def hash_jhash(spark, d):
    packed = ev(spark, d).select("packet_id", net.key_bytes(*_key()).alias("key"))
    return lookup3.with_jhash(packed, "key", 13, 0x12344321, "h").drop("key")


@query
def hash_jhash_words(spark, d):
    """One-, two- and three-word forms over the addresses and ports."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    ports = F.shiftleft(F.col("src_port").cast("bigint"), 16).bitwiseOR(F.col("dst_port").cast("bigint"))
    hashed = ev(spark, d)
    for i in (1, 2, 3):
        hashed = lookup3.with_jhash_words(hashed, [src, dst, ports][:i], 7, f"h{i}")
    return hashed.select("packet_id", "h1", "h2", "h3")


@query
def hash_xor_fold(spark, d):
    """XOR of five seeded hashes of each packet's key."""
    # Five seeds.
    seeds = (0x12344321, 0x22344323, 0x92344139, 0x78234321, 0x6A5D1F0E)
    text = net.key_text(*_key())
    hashes = [hashing.hex_number(F.md5(F.concat(F.lit(f"{s}|"), text)), 1, 8) for s in seeds]
    return ev(spark, d).select("packet_id", hashing.xor_fold(hashes).alias("h"))


# Bits ----------------------------------------------------------------------------


def _words(spark, d) -> DataFrame:
    """A 32-bit word per packet whose trailing zeros and leading ones vary."""
    v = md5_u32(F.col("packet_id"))[0]
    shifted = F.shiftleft(v, 0)
    words = ev(spark, d).select("packet_id", shifted.alias("w"), F.pmod("packet_id", F.lit(33)).cast("int").alias("s"))
    ones = F.lit(0xFFFFFFFF).bitwiseXOR(F.expr("shiftright(4294967295, s)"))
    zeros = F.expr("shiftleft(w, s)").bitwiseAND(F.lit(0xFFFFFFFF))
    return words.select("packet_id", "w", zeros.alias("low"), F.col("w").bitwiseOR(ones).alias("high"))


@query
def bits_trailing_zeros(spark, d):
    return _words(spark, d).select("packet_id", "low", bits.trailing_zeros(F.col("low")).alias("zeros"))


@query
def bits_leading_ones(spark, d):
    return _words(spark, d).select("packet_id", "high", bits.leading_ones(F.col("high")).alias("ones"))


@query
def bits_array(spark, d):
    text = lambda array: F.concat_ws("", F.transform(array, lambda b: b.cast("string")))
    w = F.col("w")
    return _words(spark, d).select(
        "packet_id",
        text(bits.bits_msb_first(w)).alias("msb_first"),
        text(bits.clear_bits_lsb_first(w)).alias("clear_lsb_first"),
        bits.bit(w, 5).alias("bit5"),
    )


@query
def floor_mean(spark, d):
    a, b = F.col("src_port") - 1500, F.col("wire_len") - 300
    return ev(spark, d).select("packet_id", bits.floor_mean(a, b).alias("mean"))


# Count-min and count sketch --------------------------------------------------------


@query
def cm_cells(spark, d):
    return cells.build_count_min(ev_counted(spark, d), SPEC)


@query
def cm_cells_md5(spark, d):
    return cells.build_count_min(ev_counted(spark, d), MD5)


@query
def cm_cells_lineitem(spark, d):
    return cells.build_count_min(li_counted(spark, d), SPEC)


def _counted_and_cells(flows: DataFrame, spec: SketchSpec, *, signed: bool) -> tuple[DataFrame, DataFrame]:
    """Keys with true counts, and cells folded from that same table."""
    counts = cells.count_keys(flows, spec)
    folded = cells.fold(with_hashes(counts, spec), spec, [F.col("n")] * spec.rows, signed=signed)
    return counts, folded


@query
def cm_estimate(spark, d):
    counts, folded = _counted_and_cells(ev_counted(spark, d), SPEC, signed=False)
    return estimate.estimate_min(counts, folded, SPEC)


@query
def cm_error(spark, d):
    counts, folded = _counted_and_cells(li_counted(spark, d), SPEC, signed=False)
    error = F.col("est") - F.col("n")
    return estimate.estimate_min(counts, folded, SPEC).agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("total"),
        F.min(error).alias("min_error"),
        F.max(error).alias("max_error"),
        F.sum(error).alias("sum_error"),
    )


@query
def key_totals(spark, d):
    """Counts and count-min estimates of keys with missing fields: no key shares the cells of another for its nulls."""
    kind = F.pmod(F.col("user_id"), F.lit(4))
    rows = flow_tables.read_table(spark, d, "events").select(
        F.when(kind != 0, F.col("user_id")).alias("user"), F.when(kind != 1, F.col("user_id")).alias("peer")
    )
    spec = SketchSpec(keys=("user", "peer"), family="md5")
    totals = cells.count_keys(rows, spec)
    return estimate.estimate_min(totals, cells.build_count_min(rows, spec), spec)


@query
def cs_cells(spark, d):
    return cells.build_count_sketch(ev_counted(spark, d), SPEC)


@query
def cs_cells_lineitem(spark, d):
    return cells.build_count_sketch(li_counted(spark, d), SPEC)


@query
def cs_cells_per_row_hash(spark, d):
    return cells.build_count_sketch(ev_counted(spark, d), MD5_ROWS)


@query
def cs_cells_xxhash32_rows(spark, d):
    """A published 32-bit hash per row, keys counted before they are hashed."""
    return cells.build_count_sketch(ev_counted(spark, d), SketchSpec(family="xxhash32_rows"), pre_aggregate=True)


@query
def cs_cells_fasthash32_rows(spark, d):
    return cells.build_count_sketch(ev_counted(spark, d), SketchSpec(family="fasthash32_rows"), pre_aggregate=True)


@query
def packets_cells(spark, d):
    """A stored table of frames, read, decoded and counted."""
    path = fresh_path(spark, "packets")
    frames.encode_frames(ev_counted(spark, d)).select(*schemas.PACKET.names).write.parquet(path)
    flows = frames.decode_frames(frames.read_packets(spark, path))
    return cells.build_count_min(flow_tables.counted(flows), SPEC)


@query
def cs_cells_fasthash(spark, d):
    """Bit-exact hash of the packed key, keys counted before they are hashed."""
    return cells.build_count_sketch(ev_counted(spark, d), SketchSpec(family="fast"), pre_aggregate=True)


def _family_query(name: str, family: str) -> None:
    def run(spark, d):
        return cells.build_count_sketch(ev_counted(spark, d), SketchSpec(family=family), pre_aggregate=True)

    QUERIES[name] = run


_family_query("cs_cells_jhash", "jhash")
_family_query("cs_cells_murmur3", "murmur3")
_family_query("cs_cells_siphash", "siphash")


@query
def cs_cells_bytes(spark, d):
    """Bytes instead of packets."""
    return cells.build_count_sketch(ev_counted(spark, d), SPEC, weight=F.col("wire_len"))


@query
def cs_estimate(spark, d):
    counts, folded = _counted_and_cells(ev_counted(spark, d), SPEC, signed=True)
    return estimate.estimate_median(counts, folded, SPEC)


@query
def cs_estimate_floor(spark, d):
    counts, folded = _counted_and_cells(li_counted(spark, d), SPEC, signed=True)
    return estimate.estimate_median(counts, folded, SPEC, floor=True)


@query
def point_query_text(spark, d):
    """Text 5-tuples, some of them broken, answered from count-min cells."""
    i = F.col("packet_id")
    texts = ev(spark, d).select(
        "packet_id",
        F.when(i % 11 == 1, F.lit("300.1.2.3")).when(i % 11 == 2, F.lit("10.0.0")).otherwise(net.long_to_ip(F.col("src_ip"))).alias("src_ip"),
        net.long_to_ip(F.col("dst_ip")).alias("dst_ip"),
        F.when(i % 11 == 3, F.lit("tcp")).otherwise(F.col("proto").cast("string")).alias("proto"),
        F.when(i % 11 == 4, F.lit("70000")).otherwise(F.col("src_port").cast("string")).alias("src_port"),
        F.col("dst_port").cast("string").alias("dst_port"),
    )
    asked = estimate.parse_query_keys(texts)
    built = cells.build_count_min(ev_counted(spark, d), SPEC)
    return estimate.estimate_min(asked, built, SPEC).select("packet_id", "est")


@query
def sketch_merge(spark, d):
    """Summaries kept per source CPU, then added up."""
    per_cpu = cells.build_count_sketch(ev_counted(spark, d), SPEC, by=("cpu",))
    return cells.merge(per_cpu.drop("cpu"))


@query
def sketch_dense(spark, d):
    dense = cells.to_dense(cells.build_count_min(ev_counted(spark, d), SPEC), SPEC)
    rows = dense.select("layer", F.posexplode("values").alias("row", "values"))
    return rows.select("layer", "row", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("cells"))


@query
def sketch_row_arrays(spark, d):
    per_cpu = cells.build_count_sketch(ev_counted(spark, d), SPEC, by=("cpu",))
    rows = cells.to_row_arrays(per_cpu, SPEC, by=("cpu",))
    return rows.select("cpu", "row", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("cells"))


@query
def sketch_dense_to_long(spark, d):
    return cells.to_long(cells.to_dense(cells.build_count_sketch(ev_counted(spark, d), SPEC), SPEC))


@query
def sketch_flat_index(spark, d):
    built = cells.build_count_min(ev_counted(spark, d), SPEC)
    flat = bits.flat_index(F.col("row"), F.col("col"), SPEC.cols)
    return built.select(flat.alias("flat"), "value").select(
        "flat", bits.row_of(F.col("flat"), SPEC.cols).alias("row"), bits.col_of(F.col("flat"), SPEC.cols).alias("col"), "value"
    )


@query
def sketch_saved(spark, d):
    """Cells written to the shared folder and probed from there."""
    path = fresh_path(spark, "cells")
    stores.write_cells(cells.build_count_min(ev_counted(spark, d), SPEC), path)
    return stores.read_cells(spark, path)


# Counters and rates ----------------------------------------------------------------


@query
def packet_byte_counts(spark, d):
    return rates.totals(ev_counted(spark, d), by=("cpu",))


@query
def packet_counts(spark, d):
    """Packets per protocol, with the counter of bytes turned off."""
    return rates.totals(ev_counted(spark, d), by=("proto",), bytes=False)


@query
def proto_counts(spark, d):
    return rates.per_protocol(ev(spark, d))


def _hourly(spark, d, by=("cpu",)) -> DataFrame:
    return rates.per_interval(ev_counted(spark, d), HOUR, by=by)


@query
def per_second_rates(spark, d):
    hourly = _hourly(spark, d)
    return hourly.withColumn("gbps", numeric.gbps(F.col("bytes") / F.lit(HOUR)))


@query
def counter_snapshots(spark, d):
    return rates.snapshots(_hourly(spark, d), HOUR, by=("cpu",))


@query
def counter_deltas(spark, d):
    """Deltas of stored snapshots, as a reader of the counters sees them."""
    counters = stored(counter_snapshots(spark, d), "snapshots")
    return rates.counter_deltas(counters, "packets", HOUR, by=("cpu",))


@query
def avg_rate(spark, d):
    deltas = rates.interval_deltas(_hourly(spark, d), by=("cpu",))
    return rates.average_rate(deltas, by=("cpu",))


@query
def avg_byte_rate(spark, d):
    mean = rates.average_rate(rates.interval_deltas(_hourly(spark, d, by=()), "bytes"))
    return mean.select("avg_rate", numeric.gbps(F.col("avg_rate")).alias("avg_gbps"))


@query
def peak_rate(spark, d):
    deltas = rates.interval_deltas(_hourly(spark, d), by=("cpu",))
    return rates.peak_rate(deltas, HOUR, by=("cpu",))


@query
def bounded_read(spark, d):
    """The first 48 samples only, without one warm-up sample."""
    first = rates.bounded(_hourly(spark, d, by=()), 48, HOUR)
    return rates.discard_warm_up(first, 1, HOUR)


@query
def throughput_units(spark, d):
    deltas = rates.interval_deltas(_hourly(spark, d), by=("cpu",))
    return deltas.select("cpu", "ts", rates.throughput(F.col("delta"), 100).alias("mega_units"))


# Sampled summaries -------------------------------------------------------------------


@query
def sampled_cells(spark, d):
    return sampling.build_sampled(ev_counted(spark, d), SAMPLED, "packet_id")


@query
def sampled_cells_md5(spark, d):
    return sampling.build_sampled(ev_counted(spark, d), SAMPLED.with_(family="md5"), "packet_id")


@query
def sampled_estimate(spark, d):
    counts = sampling.count_sampled_keys(ev_counted(spark, d), SAMPLED, "packet_id")
    built = sampling.build_from_counts(counts, SAMPLED)
    return estimate.estimate_median(counts, built, SAMPLED).select(*FLOW_KEY, "n", "est")


@query
def sampled_sweep(spark, d):
    found = sweep.sweep_estimates(ev_counted(spark, d), SPEC, "packet_id")
    errors = sweep.sweep_error(found)
    return errors.select(
        "p", F.round("mean_abs_error", 6).alias("mean_abs_error"), F.round("mean_error", 6).alias("mean_error"), "estimates"
    )


@query
def sampled_run_log(spark, d):
    """Sweep results and average counters of an hour appended to a CSV log by probability, and read back."""
    packets = ev_counted(spark, d)
    found = sweep.sweep_estimates(packets, SPEC, "packet_id", ps=(0.1, 0.5, 1.0), seeds=(1234, 2375))
    hourly = rates.per_interval(packets, HOUR, fill=False).agg(F.avg("packets"), F.avg("bytes")).first()
    runs = found.groupBy("p", "seed").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("packets"),
        F.round(F.avg(F.abs(F.col("est") - F.col("n"))), 6).alias("mean_abs_error"),
        *[F.round(F.lit(x), 6).alias(name) for x, name in zip(hourly, ("avg_packets", "avg_bytes"))],
    )
    path = fresh_path(spark, "runs")
    stores.append_run_log(runs, path)
    return spark.read.schema("seed int, keys bigint, packets bigint, mean_abs_error double, avg_packets double, avg_bytes double, p double").csv(path)


@query
def sampled_geometric(spark, d):
    return sampling.build_geometric(ev_counted(spark, d), SAMPLED, "packet_id")


@query
def sampled_geometric_slots(spark, d):
    packets = ev_counted(spark, d)
    blocks = packets.select(F.floor(F.col("packet_id") / sampling.BLOCK_PACKETS).alias("block")).distinct()
    return sampling.geometric_slots(blocks, SAMPLED)


# Layered summaries ---------------------------------------------------------------------


@query
def layered_layers(spark, d):
    keys = cells.count_keys(li_counted(spark, d), LAYERED)
    return layered.layers_of(keys, LAYERED)


@query
def layered_cells(spark, d):
    return layered.build_layered(li_counted(spark, d), LAYERED)


@query
def layered_cells_fasthash(spark, d):
    """Lanes and layers of the published hashes: 64 bits for the cells, another 32 for the layer."""
    return layered.build_layered(ev_counted(spark, d), LAYERED.with_(family="fast"), pre_aggregate=True)


@query
def layered_nested(spark, d):
    return cells.nested(layered.build_layered(li_counted(spark, d), LAYERED), LAYERED)


def _heap(spark, d) -> DataFrame:
    return layered.summarize(ev_counted(spark, d), LAYERED)


@query
def heavy_hitters(spark, d):
    return _heap(spark, d)


@query
def heavy_hitters_md5(spark, d):
    return layered.summarize(ev_counted(spark, d), LAYERED.with_(family="md5"))


@query
def heavy_hitters_lineitem(spark, d):
    return layered.summarize_pruned(li_counted(spark, d), LAYERED)


@query
def top_layer_k(spark, d):
    return topk.top_k(_heap(spark, d), 1, 10, LAYERED)


@query
def topk_merge(spark, d):
    """One heavy-hitter list per source CPU; the same key in several lists is added up."""
    lists = layered.summarize(ev_counted(spark, d), LAYERED, by=("cpu",))
    return topk.merge_heaps(lists, LAYERED)


def _parts(flows: DataFrame, by: str) -> DataFrame:
    """Estimates of every key in the summary of each group it was seen in."""
    counts = stored(cells.count_keys(flows, LAYERED, by=(by,)), "counts")
    hashed = with_hashes(counts, LAYERED, layer_hash=True)
    deepest = cells.deepest_layer(F.col("_hl"), LAYERED)
    built = cells.fold(hashed, LAYERED, [F.col("n")] * LAYERED.rows, signed=True, layer=deepest, by=(by,))
    nested = stored(cells.nest_numbered(built, LAYERED, by=(by,)), "cells")
    return stored(layered.estimates(counts, nested, LAYERED, by=(by,)), "parts")


@query
def topk_merge_exact(spark, d):
    """As topk_merge, but no key is under-counted for being below the end of a list."""
    return topk.merge_exact(_parts(ev_counted(spark, d), "cpu"), LAYERED, lists=("cpu",))


@query
def gsum_l1(spark, d):
    return layered.gsum(_heap(spark, d), LAYERED, layered.g_l1)


@query
def gsum_f2(spark, d):
    return layered.gsum(_heap(spark, d), LAYERED, layered.g_f2)


@query
def gsum_entropy(spark, d):
    return layered.gsum(_heap(spark, d), LAYERED, layered.g_entropy).select(F.round("gsum", 4).alias("gsum"))


@query
def count_distinct_gsum(spark, d):
    return layered.count_distinct(_heap(spark, d), LAYERED)


@query
def count_distinct_gsum_lineitem(spark, d):
    return layered.count_distinct(layered.summarize_pruned(li_counted(spark, d), LAYERED), LAYERED)


@query
def sampled_layered(spark, d):
    """Sampled updates in the layered summary; keys are listed when a sampled refresh saw them."""
    spec = LAYERED.with_(p=0.5)
    counts = sampling.count_sampled_keys(ev_counted(spark, d), spec, "packet_id", refresh_p=0.5)
    built = sampling.build_from_counts(counts, spec, layered=True)
    candidates = counts.filter(F.col("refreshes") > 0)
    return layered.heavy_hitters(candidates, cells.nest_numbered(built, spec), spec)


# Medians ---------------------------------------------------------------------------------


@query
def median_rows(spark, d):
    values = [F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    lines = flow_tables.read_table(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numeric.median(values).alias("median"))


@query
def median_of_five(spark, d):
    lines = flow_tables.read_table(spark, d, "lineitem")
    values = [F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")]
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", numeric.median_of_five(*values).alias("median"))


# Keyed tables ------------------------------------------------------------------------------


def _ops(spark, d) -> DataFrame:
    return flow_tables.read_table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") * 7919 + F.col("event_id")).alias("x")
    )


@query
def keyed_inc(spark, d):
    return keyed.increment(_ops(spark, d), SLOTS)


@query
def keyed_inc_first_zero(spark, d):
    return keyed.increment_after_insert(_ops(spark, d), 1 << 13)


@query
def keyed_last_write(spark, d):
    return keyed.last_write(_ops(spark, d), SLOTS)


@query
def keyed_write_first_const(spark, d):
    return keyed.write_after_insert(_ops(spark, d), 1 << 13)


@query
def keyed_const(spark, d):
    return keyed.write_constant(_ops(spark, d), 1 << 13)


@query
def keyed_lookup_default(spark, d):
    """Counters of the order keys, read for every event."""
    orders = flow_tables.read_table(spark, d, "orders").select((F.col("o_custkey") * 3).alias("x"))
    table = keyed.increment(orders, 4096)
    return keyed.lookup(_ops(spark, d), table, 4096, default=0)


@query
def table_checksum(spark, d):
    packets = ev(spark, d)
    text = F.concat_ws("|", "packet_id", net.key_text(*_key()), "wire_len")
    return keyed.table_checksum(packets, hashing.hex_number(F.md5(text), 1, 15))


# Streams -------------------------------------------------------------------------------------


#: Files that a micro-batch takes at most.
STREAM_FILES = 64


def _events(spark, d) -> DataFrame:
    return flow_tables.flows_from_events(flow_tables.stream_table(spark, d, "events", schemas.EVENTS, STREAM_FILES))


def _event_stream(spark, d) -> DataFrame:
    return flow_tables.counted(_events(spark, d))


@query
def stream_cells(spark, d):
    table = VersionedTable(spark, fresh_path(spark, "stream-cells"))
    run = summaries.start_cells(_event_stream(spark, d), SPEC, table, fresh_path(spark, "checkpoint"))
    run.awaitTermination()
    return table.latest()


@query
def stream_state_cells(spark, d):
    """The cells of a stream from its state, as a reader sees them while the query runs."""
    table, checkpoint = VersionedTable(spark, fresh_path(spark, "stream-cells")), fresh_path(spark, "checkpoint")
    summaries.start_cells(_event_stream(spark, d), SPEC, table, checkpoint).awaitTermination()
    return summaries.state_cells(spark, checkpoint, SPEC)


@query
def stream_packets_cells(spark, d):
    """Frames that arrive as files, decoded and counted.

    They come in four micro-batches, each of as many files as Spark splits the table into, so that files stay small
    and a batch has work for every core.
    """
    path = fresh_path(spark, "packets")
    packets = ev_counted(spark, d)
    files = max(1, packets.rdd.getNumPartitions())
    frames.encode_frames(packets.repartition(4 * files)).select(*schemas.PACKET.names).write.parquet(path)
    flows = frames.decode_frames(frames.stream_packets(spark, path, files=files))
    table = VersionedTable(spark, fresh_path(spark, "stream-cells"))
    summaries.start_cells(flow_tables.counted(flows), SPEC, table, fresh_path(spark, "checkpoint")).awaitTermination()
    return table.latest()


@query
def stream_windowed_cells(spark, d):
    """Windows that the watermark has passed are final and stored; the others come from the state."""
    table, checkpoint = FoldedTable(spark, fresh_path(spark, "stream-windows")), fresh_path(spark, "checkpoint")
    run = summaries.start_windowed_cells(_event_stream(spark, d), SPEC, table, checkpoint, window="1 day", delay="1 hour")
    run.awaitTermination()
    found = summaries.read_windowed_cells(spark, table, checkpoint, SPEC)
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *cells.CELL, "value")


@query
def stream_counters(spark, d):
    """Changed intervals of every micro-batch, folded to the last row of each."""
    table = FoldedTable(spark, fresh_path(spark, "stream-counters"), keys=["window"])
    counters = summaries.interval_counters(_event_stream(spark, d), "1 hour", "1 hour")
    summaries.start_updates(counters, table, fresh_path(spark, "checkpoint")).awaitTermination()
    return table.read().select(F.col("window.start").cast("timestamp_ntz").alias("ts"), "packets", "bytes")


@query
def stream_heavy_hitters(spark, d):
    built, heap, pool = (VersionedTable(spark, fresh_path(spark, f"stream-{n}")) for n in ("layered", "heap", "pool"))
    checkpoint = fresh_path(spark, "checkpoint")
    run = summaries.start_heavy_hitters(_event_stream(spark, d), LAYERED, built, heap, pool, checkpoint)
    run.awaitTermination()
    return heap.latest()


@query
def stream_redirect(spark, d):
    """Packets counted and forwarded in one pass over each micro-batch: what was counted, where as much was sent."""
    table = VersionedTable(spark, fresh_path(spark, "tee-totals"))
    forwarded = fresh_path(spark, "tee-forwarded")
    keys = ("verdict", "proto")

    def count(df: DataFrame, batch: int) -> None:
        found = rates.totals(flow_tables.counted(df), by=keys)
        if batch > 0:
            both = found.unionByName(table.read(batch - 1))
            found = both.groupBy(*keys).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
        table.write(found, batch)

    run = summaries.start_tee(_events(spark, d), count, forwarded, fresh_path(spark, "checkpoint"))
    run.awaitTermination()
    sent = rates.totals(spark.read.parquet(forwarded), by=keys)
    return table.latest().join(sent, [*keys, "packets", "bytes"], "left_semi")
