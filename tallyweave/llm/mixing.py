"""Mixing sources to target weights by capped water-filling.

Every source asks for words in proportion to its weight. A source whose share would exceed
``max_epochs`` passes over its documents is clamped there, and what it leaves is shared out among
the others by weight, until no source is above its clamp. Each source is then sampled: every
document is repeated as often as whole passes fit the target, and one more, fractional pass takes
documents in a seeded order until the target is met; the documents at its edge are taken in part.

Skew: documents are only ever aggregated to (source, slot) cells with map-side combining, and
joined with one row per source, so a source that holds most rows is never gathered in one task.

Defined cases: a null text has size 0; a null source is a source of its own and sorts last; a null
id is hashed as the empty string; repeated rows are separate documents and are treated alike;
an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import textcols
from tallyweave.llm.frames import bounded, id_text, map_arrow, same
from tallyweave.session import stored


@dataclass(frozen=True)
class Mix:
    """How to mix: weights by source rank (repeating), the budget as a ratio of all words, the clamp,
    the seed of the order in which a fractional pass takes documents, and the slots of that order."""

    weights: Sequence[int] = (3, 1, 2)
    share: tuple[int, int] = (3, 2)
    max_epochs: int = 2
    seed: str = "mix"
    slots: int = 1024


def count_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, text) to (doc_id, source, size)."""
    sizes = [np.diff(textcols.words(part).firsts) for _, part in textcols.slices(batch.column(2))]
    size = pa.array(np.concatenate(sizes), pa.int64())
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size], names=["doc_id", "source", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of every document."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "source", "text")
    return map_arrow(rows, count_words, f"doc_id {ids}, source string, size bigint")


def slot(mix: Mix) -> Column:
    """The place of a document in its source's seeded order, 0 to slots - 1."""
    digest = F.md5(F.concat(F.lit(f"{mix.seed}-"), id_text("doc_id")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(mix.slots))


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 by code point, null last: ranks inside range partitions plus their offsets."""
    placed = stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "part")
        .withColumn("rank", F.col("place") + F.col("offset"))
        .drop("part", "place", "offset")
    )


def water_level(sources: DataFrame, mix: Mix) -> tuple[float, int]:
    """(words per unit of weight of the sources below their clamp, number of sources)."""
    n, d = mix.share
    level, rows = 0.0, 0
    while True:
        clamped = F.col("clamp") < F.lit(level) * F.col("weight")
        found = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(clamped, F.col("clamp")).otherwise(0)).alias("held"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count("*").alias("rows"),
        ).first()
        rows = found["rows"]
        if not rows or not found["weight"]:
            return level, rows
        # At least what the previous round gave: clamping only ever raises the level.
        risen = max(level, (n * found["total"] - d * found["held"]) / (d * found["weight"]))
        if risen == level:
            return level, rows
        level = risen


def targets(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """(one row per source: source, source_size, target, whole passes, edge slot and its part; rows)."""
    cells = sizes.groupBy("source", slot(mix).alias("slot")).agg(F.sum("size").alias("words"))
    cells = stored(cells, "mix-cells")
    weights = F.array(*[F.lit(int(w)) for w in mix.weights])
    sources = ranked(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    sources = sources.select(
        "source",
        "source_size",
        (F.col("source_size") * mix.max_epochs).alias("clamp"),
        F.get(weights, F.pmod(F.col("rank"), F.lit(len(mix.weights))).cast("int")).alias("weight"),
    )
    sources = stored(sources, "mix-sources")
    level, rows = water_level(sources, mix)
    share = F.lit(level) * F.col("weight")
    target = F.when(F.col("clamp") < share, F.col("clamp").cast("double")).otherwise(share)
    aims = sources.select("source", "source_size", target.alias("target")).withColumns(
        {"whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))}
    )
    aims = aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # At most ``slots`` cells per source.
    until = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.withColumn("upto", F.sum("words").over(until)).withColumnRenamed("source", "c_source")
    joined = running.join(
        bounded(aims.select(F.col("source").alias("a_source"), "rest"), rows), same(F.col("c_source"), F.col("a_source"))
    )
    edges = (
        joined.where(F.col("upto") > F.col("rest"))
        .groupBy("c_source")
        .agg(F.min(F.struct("slot", "upto", "words", "rest")).alias("e"))
        .select(
            "c_source",
            F.col("e.slot").alias("edge"),
            ((F.col("e.rest") - (F.col("e.upto") - F.col("e.words"))) / F.col("e.words")).alias("part"),
        )
    )
    plan = aims.join(edges, same(F.col("source"), F.col("c_source")), "left").drop("c_source", "rest")
    return plan, rows


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and passes (whole ones, with the
    extra one where the document is taken once more) and partial (words of a pass taken in part)."""
    sizes = stored(sized(docs), "mix-sizes")
    plan, rows = targets(sizes, mix)
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "edge", "part")
    joined = sizes.withColumn("slot", slot(mix)).join(bounded(plan, rows), same(F.col("source"), F.col("p_source")))
    # Without an edge the rest is nothing.
    extra = F.when(F.col("slot") < F.col("edge"), 1).otherwise(0)
    partial = F.when(F.col("slot") == F.col("edge"), F.floor(F.col("size") * F.col("part"))).otherwise(F.lit(0))
    joined = joined.withColumns({"passes": (F.col("whole") + extra).cast("bigint"), "partial": partial.cast("bigint")})
    taken = F.col("passes") * F.col("size") + F.col("partial")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "partial")


def first_words(texts: pa.Array, keep: np.ndarray) -> pa.Array:
    """Every text up to the end of its ``keep``-th word; unchanged where keep is negative."""
    out: list[str | None] = []
    for start, part in textcols.slices(texts):
        found = textcols.words(part)
        for i in range(len(part)):
            k = int(keep[start + i])
            if k < 0:
                value = texts[start + i].as_py()
            elif k == 0:
                value = ""
            else:
                last = min(found.firsts[i] + k, found.firsts[i + 1]) - 1
                value = found.data[found.offsets[i] : found.ends[last]].tobytes().decode()
            out.append(value)
    return pa.array(out, pa.string())


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: documents as rows, repeated as often as they are taken, with the last one cut to the
    words of a partial pass. Columns are those of ``docs``; n_chars follows the text where there is one."""
    plan, rows = targets(stored(sized(docs), "mix-sizes"), mix)
    plan = plan.select(F.col("source").alias("_p_source"), F.col("whole").alias("_whole"), F.col("edge").alias("_edge"),
                       F.col("part").alias("_part"))
    taken = docs.withColumn("_slot", slot(mix)).join(bounded(plan, rows), same(F.col("source"), F.col("_p_source")))
    extra = F.when(F.col("_slot") < F.col("_edge"), 1).otherwise(0)
    copies = F.array_repeat(F.lit(-1.0), (F.col("_whole") + extra).cast("int"))
    edge = F.when(F.col("_slot") == F.col("_edge"), F.array(F.col("_part").cast("double"))).otherwise(F.array().cast("array<double>"))
    rows_ = taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.concat(copies, edge)).alias("_share"))
    place, names = docs.columns.index("text"), docs.columns

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        share = np.asarray(batch.column(len(names)))
        texts = batch.column(place)
        if (share >= 0).any():
            sizes = np.concatenate([np.diff(textcols.words(p).firsts) for _, p in textcols.slices(texts)])
            texts = first_words(texts, np.where(share >= 0, np.floor(sizes * share), -1).astype(np.int64))
        columns = [texts if i == place else batch.column(i) for i in range(len(names))]
        if "n_chars" in names:
            columns[names.index("n_chars")] = pc.utf8_length(texts).cast(pa.int64())
        kept = pa.RecordBatch.from_arrays(columns, names=names)
        # A part of no words is no document.
        yield kept.filter(pa.array((share < 0) | (np.asarray(pc.fill_null(pc.utf8_length(texts), 0)) > 0)))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(rows_, cut, ddl)
