"""Quality rules judged by host.

Counts of words, symbols, repeated lines and repeated phrases are taken from every text. Rules on these
counts mark documents; a document that breaks a base rule goes. For the rest the host decides: the share of its
documents that break any rule, shrunk towards the share usual among hosts, so that a host with few documents
is not condemned by one of them. The beta prior of these shares is fitted to all hosts by their mean and variance.

Skew: hosts are aggregated with map-side combining and their verdicts joined back by a broadcast while there are
few hosts, else by a shuffle whose hot partitions Spark may split.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows are separate documents; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import textcols
from tallyweave.llm.frames import bounded, map_arrow, same
from tallyweave.session import stored

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules. Percentages are of the words, or of the lines for ``dup_lines``."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 10
    dup_line_percent: int = 30
    word_chars: tuple[int, int] = (2, 20)
    #: A host goes when its shrunk share of failing documents is above this.
    host_share: float = 0.5


def per_row(marked: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows[marked], minlength=n)[:n].astype(np.int64)


def measure(column: pa.Array) -> np.ndarray:
    """COUNTS of every row of a slice."""
    n = len(column)
    found = textcols.words(column)
    data, offsets = found.data, found.offsets
    n_words = np.diff(found.firsts)
    word_chars = textcols.counts(((data & 0xC0) != 0x80) & ~textcols.SPACE[data], offsets)
    n_symbols = textcols.counts(SYMBOLS[data], offsets)

    prefix = textcols.prefix_hash(textcols.byte_values()[data])
    salt = textcols.mix(np.arange(n, dtype=np.uint64) + np.uint64(7))  # keeps equal hashes of two rows apart

    # Lines end at a line feed or at the end of their row.
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    stops = np.sort(np.concatenate([feeds, offsets[1:]]))
    row = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, side="right") - 1]))
    has_word = np.searchsorted(found.starts, stops) > np.searchsorted(found.starts, starts)
    keys = textcols.mix(textcols.span_hash(prefix, starts, stops) ^ salt[row])
    again = np.ones(len(keys), dtype=bool)
    again[np.unique(keys, return_index=True)[1]] = False
    n_dup_lines = per_row(again & has_word, row, n)
    n_lines = np.bincount(row, minlength=n)

    hashes = textcols.span_hash(prefix, found.starts, found.ends)
    grams, at = textcols.windows(hashes, found.rows, 3)
    grams = textcols.mix(grams ^ salt[found.rows[at]])
    order = np.argsort(grams)
    ordered = grams[order]
    equal = np.zeros(len(grams), dtype=bool)
    equal[1:] = ordered[1:] == ordered[:-1]
    equal[:-1] |= equal[1:]
    twice = at[order[equal]]
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    n_repeat_words = per_row(covered, found.rows, n)
    return np.stack([n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words], axis=1)


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host and COUNTS of every document."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "host", *COUNTS]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([measure(part) for _, part in textcols.slices(batch.column(2))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in counts.T]], names=names
        )

    schema = f"doc_id {ids}, host string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return map_arrow(docs.select("doc_id", host.cast("string").alias("host"), "text"), run, schema)


def failures(rules: Rules) -> dict[str, Column]:
    """The rules, by name, as conditions that hold where a document breaks them. The first two are the base rules."""
    words = F.col("n_words")
    low, high = rules.word_chars
    return {
        "few_words": words < rules.min_words,
        "repeats": 100 * F.col("n_repeat_words") > rules.repeat_percent * words,
        "symbols": 100 * F.col("n_symbols") > rules.symbol_percent * words,
        "same_lines": 100 * F.col("n_dup_lines") > rules.dup_line_percent * F.col("n_lines"),
        "word_length": (F.col("word_chars") < low * words) | (F.col("word_chars") > high * words),
    }


def any_of(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


def host_rates(rows: DataFrame, rules: Rules) -> DataFrame:
    """host, docs, failed (documents that break any rule) and failures of each rule."""
    broken = failures(rules)
    return rows.groupBy("host").agg(
        F.count("*").alias("docs"),
        F.sum(any_of(list(broken.values())).cast("bigint")).alias("failed"),
        *[F.sum(c.cast("bigint")).alias(f"failed_{name}") for name, c in broken.items()],
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float, int]:
    """(alpha, beta, hosts) of the failure shares, by moments: the mean over all documents, the spread
    over hosts weighted by their documents, less what binomial noise adds."""
    total = hosts.agg(F.sum("docs").alias("docs"), F.sum("failed").alias("failed"), F.count("*").alias("hosts")).first()
    docs, n = total["docs"] or 0, total["hosts"]
    mean = (total["failed"] or 0) / docs if docs else 0.0
    if not 0 < mean < 1 or n < 2:
        return mean + 1e-9, 1 - mean + 1e-9, n
    share = F.col("failed") / F.col("docs") - F.lit(mean)
    spread = hosts.agg(F.sum(F.col("docs") * share * share)).first()[0] / docs
    noise = mean * (1 - mean) * n / docs
    variance = max(spread - noise, mean * (1 - mean) / 1e6)
    strength = max(mean * (1 - mean) / variance - 1, 1e-6)
    return mean * strength, (1 - mean) * strength, n


def judge(docs: DataFrame, host: Column, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id, host, COUNTS, base_failed, the shrunk host_share and kept."""
    rows = stored(measured(docs, host), "rules")
    hosts = stored(host_rates(rows, rules), "hosts")
    alpha, beta, n = beta_prior(hosts)
    shrunk = (F.col("failed") + F.lit(alpha)) / (F.col("docs") + F.lit(alpha + beta))
    verdicts = hosts.select(F.col("host").alias("h_host"), shrunk.alias("host_share"))
    broken = list(failures(rules).values())
    joined = rows.join(bounded(verdicts, n), same(F.col("host"), F.col("h_host"))).drop("h_host")
    joined = joined.withColumn("base_failed", broken[0] | broken[1])
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_share") <= rules.host_share))
