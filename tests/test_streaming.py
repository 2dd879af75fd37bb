from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators import cells, layered, rates
from tallyweave.operators.frequent import keep_frequent
from tallyweave.session import fresh_path, shared_dir
from tallyweave.sources import flows as flow_tables
from tallyweave.spec import FLOW_KEY, SketchSpec
from tallyweave.plans import queries
from tallyweave.streaming import summaries
from tallyweave.streaming.tables import FoldedTable, VersionedTable

SPEC = SketchSpec()
LAYERED = SketchSpec(layers=8, heap_size=16)


@pytest.fixture(scope="module")
def source(spark, skewed):
    """The packets as six files in time order, and a stream that reads one per batch."""
    path = fresh_path(spark, "packets")
    for i in range(6):
        part = skewed.filter(F.floor(F.col("packet_id") / 3334) == i)
        part.coalesce(1).write.parquet(f"{path}/part={i}")

    def stream():
        reader = spark.readStream.schema(T.StructType([*skewed.schema, T.StructField("part", T.IntegerType())])).option("maxFilesPerTrigger", 1)
        return reader.option("latestFirst", "false").parquet(path)

    return stream


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect() if r["value"] != 0)


def test_stream_ends_with_the_cells_of_a_batch(spark, source, skewed):
    for signed in (False, True):
        table = VersionedTable(spark, fresh_path(spark, "cells"))
        run = summaries.start_cells(source(), SPEC, table, fresh_path(spark, "ck"), signed=signed)
        run.awaitTermination()
        batches = sum(p["numInputRows"] > 0 for p in run.recentProgress)
        assert batches == 6
        assert rows(table.latest()) == rows(cells.build(skewed, SPEC, signed=signed))


def test_stream_resumes_from_its_checkpoint(spark, skewed):
    path, checkpoint = fresh_path(spark, "grow"), fresh_path(spark, "ck")
    table = VersionedTable(spark, fresh_path(spark, "cells"))
    for i in range(2):
        skewed.filter(f"packet_id % 2 = {i}").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(skewed.schema).parquet(path)
        summaries.start_cells(stream, SPEC, table, checkpoint).awaitTermination()
    assert rows(table.latest()) == rows(cells.build_count_min(skewed, SPEC))


def test_windows_and_counters(spark, source, skewed):
    table, checkpoint = FoldedTable(spark, fresh_path(spark, "windows"), every=2), fresh_path(spark, "ck")
    run = summaries.start_windowed_cells(source(), SPEC, table, checkpoint, window="5 minutes", delay="6 minutes")
    run.awaitTermination()
    found = summaries.read_windowed_cells(spark, table, checkpoint, SPEC)
    batch = cells.build_count_min(skewed.withColumn("window", F.window("ts", "5 minutes")), SPEC, by=("window",))
    assert rows(found) == rows(batch)
    # Every window is in one place only, and both places hold some.
    final, still_open = (df.select("window").distinct() for df in (table.read(), summaries.read_state(spark, checkpoint, ["value"])))
    assert final.count() and still_open.count() and not final.intersect(still_open).count()

    table = FoldedTable(spark, fresh_path(spark, "counters"), keys=["window"], every=2)
    counters = summaries.interval_counters(source(), "1 minute", "10 minutes")
    summaries.start_updates(counters, table, fresh_path(spark, "ck")).awaitTermination()
    found = table.read().select(F.col("window.start").alias("ts"), "packets", "bytes")
    expected = rates.per_interval(skewed, 60, fill=False)
    assert found.exceptAll(expected).count() == 0 and found.count() == expected.count()


def test_reading_does_not_grow_with_batches(spark):
    """Forty batches: no more folders are read than after four, whether rows replace each other or all stay."""
    for keys, expected in ((["k"], {(k, 39) for k in range(5)}), ([], {(k, b) for k in range(5) for b in range(40)})):
        table = FoldedTable(spark, fresh_path(spark, "folded"), keys=keys, every=4)
        for b in range(40):
            table.write(spark.range(5, numPartitions=1).select(F.col("id").alias("k"), F.lit(b).alias("v")), b)
            if b == 20:
                held = table.read()
        folders = {f.rsplit("/", 1)[0] for f in table.read().inputFiles()}
        assert len(folders) <= 6
        assert {tuple(r) for r in table.read().select("k", "v").collect()} == expected
        assert table.read(38).where("v = 39").count() == 0 and table.read(38).where("v = 38").count() == 5
        table.write(spark.range(5, numPartitions=1).select(F.col("id").alias("k"), F.lit(39).alias("v")), 39)  # run again
        assert {tuple(r) for r in table.read().select("k", "v").collect()} == expected
        assert len(held.inputFiles()) > 0


def test_state_is_read_while_the_query_runs(spark, skewed):
    path, checkpoint = fresh_path(spark, "live"), fresh_path(spark, "ck")
    skewed.where("packet_id % 3 = 0").coalesce(1).write.parquet(path)
    table = VersionedTable(spark, fresh_path(spark, "cells"))
    stream = spark.readStream.schema(skewed.schema).parquet(path)
    run = summaries.start_cells(stream, SPEC, table, checkpoint, trigger={"processingTime": "0 seconds"})
    try:
        run.processAllAvailable()
        first = summaries.state_cells(spark, checkpoint, SPEC)
        assert rows(first) == rows(cells.build_count_min(skewed.where("packet_id % 3 = 0"), SPEC))
        skewed.where("packet_id % 3 > 0").coalesce(1).write.mode("append").parquet(path)
        run.processAllAvailable()
        assert run.isActive
        assert rows(summaries.state_cells(spark, checkpoint, SPEC)) == rows(cells.build_count_min(skewed, SPEC))
        assert summaries.committed_batch(spark, checkpoint) == 1
        before = summaries.read_state(spark, checkpoint, ["value"], batch=0)
        assert rows(cells.unnumber_cells(before, SPEC)) == rows(cells.build_count_min(skewed.where("packet_id % 3 = 0"), SPEC))
    finally:
        run.stop()


def test_heavy_hitters_stay_current(spark, source, skewed):
    built, heap, pool = (VersionedTable(spark, fresh_path(spark, n)) for n in ("cells", "heap", "pool"))
    run = summaries.start_heavy_hitters(source(), LAYERED, built, heap, pool, fresh_path(spark, "ck"))
    run.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in run.recentProgress) == 6
    # Every packet is read once.
    assert sum(p["numInputRows"] for p in run.recentProgress) == 20000
    final = cells.build_count_sketch(skewed, LAYERED, layered=True)
    assert rows(cells.unnumber_cells(built.latest(), LAYERED)) == rows(final)
    listed = heap.latest()
    top = listed.filter("layer = 0 and rank = 1").first()
    whole = layered.summarize(skewed, LAYERED)
    # Listed estimates come from the final cells, so they equal those of a batch run.
    shared = listed.join(whole.select("layer", *FLOW_KEY, F.col("est").alias("batch_est")), ["layer", *FLOW_KEY])
    assert shared.filter("est <> batch_est").count() == 0
    assert top.est == whole.filter("layer = 0 and rank = 1").first().est


def test_no_frequent_key_is_forgotten(spark):
    """Eight batches. Keys 1 to 3 come in some of them only, and are never among the first of a batch or of the list then."""
    spec = SketchSpec(keys=("key",), layers=4, heap_size=4, cols=1024)
    path, size = fresh_path(spark, "bursts"), 33
    packets = []
    for b in range(8):
        early = [1] * 60 + [2] * 55 if b < 3 else [3] * 45 if b < 6 else []
        crowd = [100 + 10 * b + i for i in range(8) for _ in range(70 if b < 6 else 20)]
        rare = [10000 + 200 * b + i for i in range(150)]
        packets.append(early + crowd + rare)
        spark.createDataFrame([(k,) for k in packets[-1]], "key long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key long").option("maxFilesPerTrigger", 1).parquet(path)
    built, heap, pool = (VersionedTable(spark, fresh_path(spark, n)) for n in ("cells", "heap", "pool"))
    run = summaries.start_heavy_hitters(stream, spec, built, heap, pool, fresh_path(spark, "ck"), pool_size=size)
    run.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in run.recentProgress) == 8
    counts = Counter(k for batch in packets for k in batch)
    frame = spark.createDataFrame([(k,) for batch in packets for k in batch], "key long")
    deepest = {r["key"]: r["deepest"] for r in layered.layers_of(frame.distinct(), spec).collect()}
    kept = pool.latest().groupBy("layer").agg(F.collect_set("key")).collect()
    assert len(kept) == 4
    for layer, keys in kept:
        inside = {k: n for k, n in counts.items() if deepest[k] >= layer}
        frequent = {k for k, n in inside.items() if n > sum(inside.values()) / (size + 1)}
        assert frequent <= set(keys) and len(keys) <= size
    assert {1, 2} <= {k for k, n in counts.items() if n > sum(counts.values()) / (size + 1)}
    whole = {(r["layer"], r["key"]): r["est"] for r in layered.summarize(frame, spec).collect()}
    listed = {(r["layer"], r["key"]): r["est"] for r in heap.latest().collect()}
    for layer in range(4):
        total = sum(n for k, n in counts.items() if deepest[k] >= layer)
        for (at, key), est in whole.items():
            if at == layer and counts[key] > total / (size + 1):
                assert listed[at, key] == est


def test_kept_counts_lose_no_more_than_their_share(spark):
    draw = np.random.default_rng(3)
    parts = [[int(k) for k in draw.zipf(1.3, 400) % 97] for _ in range(5)]
    kept = spark.createDataFrame([], "g int, key int, n long")
    for part in parts:
        rows_ = [(k % 2, k, n) for k, n in Counter(part).items()]
        kept = keep_frequent(kept.union(spark.createDataFrame(rows_, "g int, key int, n long")), ["key"], 6, by=["g"])
    found = {r["key"]: r["n"] for r in kept.collect()}
    counts = Counter(k for part in parts for k in part)
    for g in (0, 1):
        total = sum(n for k, n in counts.items() if k % 2 == g)
        for k, n in counts.items():
            if k % 2 == g:
                assert n - total / 7 <= found.get(k, 0) <= n


def test_a_repeated_batch_changes_nothing(spark, skewed):
    table = VersionedTable(spark, fresh_path(spark, "t"))
    table.write(spark.range(3), 0)
    table.write(spark.range(5), 1)
    table.write(spark.range(5), 1)
    assert table.latest().count() == 5 and table.read(0).count() == 3
    table.write(spark.range(7), 2)
    assert table.latest().count() == 7 and table.read(1).count() == 5


def test_tee_counts_and_forwards(spark, source, skewed):
    forwarded, seen = fresh_path(spark, "sent"), []
    marked = source().withColumn("verdict", F.when(F.col("packet_id") % 2 == 0, "COUNTED").otherwise("PASS"))
    run = summaries.start_tee(marked, lambda df, batch: seen.append(df.count()), forwarded, fresh_path(spark, "ck"))
    run.awaitTermination()
    assert sum(seen) == 20000
    sent = spark.read.parquet(forwarded)
    assert sent.count() == 10000 and flow_tables.counted(sent).count() == 10000


STREAMS = ("stream_cells", "stream_state_cells", "stream_counters", "stream_heavy_hitters", "stream_redirect", "stream_windowed_cells")


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_folders_in_several_batches(spark, data_dir, name, monkeypatch):
    """A table of four files in time order, read one at a time, gives what the single file gives."""
    folder = fresh_path(spark, "tables")
    events = spark.read.parquet(f"{data_dir}/events.parquet").withColumn("quarter", F.ntile(4).over(Window.orderBy("ts")))
    spark.range(1).write.parquet(f"{folder}/events.parquet_old")
    for k in (1, 2, 3, 4):
        part = events.where(F.col("quarter") == k).drop("quarter").coalesce(1)
        part.write.mode("append").parquet(f"{folder}/events.parquet")
    whole = queries.QUERIES[name](spark, data_dir)
    rows = sorted(whole.collect(), key=str)
    monkeypatch.setattr(queries, "STREAM_FILES", 1)
    found = queries.QUERIES[name](spark, folder)
    assert sorted(found.select(*whole.columns).collect(), key=str) == rows


def test_a_file_is_streamed_without_its_neighbours(spark, data_dir, tmp_path):
    import shutil

    for name in ("events.parquet", "events.parquet_old", "events.parquetX"):
        shutil.copy(f"{data_dir}/events.parquet", tmp_path / name)
    counted = queries.QUERIES["stream_counters"](spark, str(tmp_path)).agg(F.sum("packets")).first()[0]
    assert counted == queries.ev_counted(spark, data_dir).count()


def test_frames_come_in_more_files_where_the_table_is_larger(spark, data_dir, monkeypatch):
    """Four micro-batches for any table: a batch of a folder of three files has three files."""
    folder, seen, read = fresh_path(spark, "tables"), [], queries.frames.stream_packets
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")

    def stream_packets(spark, path, files):
        seen.append((len(spark.read.parquet(path).inputFiles()), files))
        return read(spark, path, files=files)

    monkeypatch.setattr(queries.frames, "stream_packets", stream_packets)
    monkeypatch.setattr(queries, "VersionedTable", lambda *a: versions.append(VersionedTable(*a)) or versions[-1])
    versions = []
    expected = rows(queries.QUERIES["packets_cells"](spark, data_dir))
    for d in (data_dir, folder):
        assert rows(queries.QUERIES["stream_packets_cells"](spark, d)) == expected
    assert seen == [(4, 1), (12, 3)]
    assert [t.versions() for t in versions] == [[0, 1, 2, 3]] * 2


def test_reader_outlives_three_writes(spark):
    table = VersionedTable(spark, fresh_path(spark, "versions"))
    table.write(spark.range(5), 0)
    held = table.latest()
    for version in (1, 2, 3):
        table.write(spark.range(10 + version), version)
    assert held.count() == 5 and table.latest().count() == 13
    for version in range(4, 14):
        table.write(spark.range(version), version)
    assert table.versions() == list(range(6, 14))
