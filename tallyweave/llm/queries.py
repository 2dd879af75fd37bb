"""The queries of this package, by name. Each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, fingerprint, hostrules, jaccard, language, licences, linededup, mixing, packing, quality, trie, whitening, wrappers
from tallyweave.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_host_rules(spark: SparkSession, directory: str) -> DataFrame:
    found = hostrules.judge(table(spark, directory, "documents"), F.col("source"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op7_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(table(spark, directory, "documents"))


@query
def op9_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    found = linededup.with_bitmaps(docs)
    kept = F.array_join(linededup.kept_lines(F.col("text"), F.col("_bitmap")), "\n")
    return found.select(
        "doc_id",
        F.size(linededup.lines(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("_n_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op10_mixing(spark: SparkSession, directory: str) -> DataFrame:
    found = mixing.mix_sources(table(spark, directory, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprint.fingerprint_neighbours(table(spark, directory, "documents"))


@query
def op3_quality(spark: SparkSession, directory: str) -> DataFrame:
    held_out = quality.remainder(5) == 0
    found = quality.classify(table(spark, directory, "documents"), table(spark, directory, "labels"), held_out)
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op5_language(spark: SparkSession, directory: str) -> DataFrame:
    held_out = quality.remainder(3) == 1
    docs = table(spark, directory, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.fit(docs, held_out))
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_html_wrappers(spark: SparkSession, directory: str) -> DataFrame:
    return wrappers.main_text(table(spark, directory, "pages"))


@query
def op4_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard.near_copies(table(spark, directory, "documents"))


@query
def op2_licences(spark: SparkSession, directory: str) -> DataFrame:
    return licences.scan(table(spark, directory, "documents"))


@query
def op11_whitening(spark: SparkSession, directory: str) -> DataFrame:
    found = whitening.whiten(table(spark, directory, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query
def op12_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    return trie.prefix_trie(table(spark, directory, "conversations"))


@query
def op13_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    found = bpe.recode(table(spark, directory, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
