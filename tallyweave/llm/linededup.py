"""Line deduplication that returns which lines to keep, as bitmaps, instead of text.

Only hashes of line keys travel, with the document and the position they come from. They are range-partitioned
by hash: the range of a hash is its upper half, which cuts the hash space into equal parts, as hashes are uniform.
A range is further cut into slices by document, so that a line that stands in a third of all documents is not
gathered in one task. Inside a slice rows are sorted by hash, document and position and are streamed once: the
first line of each document is its first occurrence. Each run sends one row (documents, largest document) to the
total of its key, of which there are at most ``SLICES`` rows. Lines to drop set a bit in a bitmap of their
document, kept as the words that have any bit.

Native: DataFrame functions only. Keys are compared by two 64-bit hashes.

Defined cases: a null or empty text is one empty line; a null id is a document like any other and is smaller
than all ids; rows with the same id are the same document (their lines count once) and each keeps its own text;
an empty table gives an empty result; other columns are passed through or not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts, by document, that the lines of one hash range are cut into.
SLICES = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(_BLANK))
    # On pure ASCII lower() does just that, and faster.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _UPPER, _UPPER.lower())
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, version (a hash of the text), position, and range, slice, h1, h2 of each line long enough."""
    rows = docs.select(
        "doc_id", text_hash(F.col("text")).alias("version"), F.posexplode(lines(F.col("text"))).alias("position", "line")
    )
    keys = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    h1 = F.xxhash64("key")
    return keys.select(
        F.shiftright(h1, 32).cast("int").alias("range"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"),
        h1.alias("h1"),
        F.xxhash64(F.lit("second"), "key").alias("h2"),
        "doc_id",
        "version",
        "position",
    )


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, version and position of every line to drop."""
    placed = hashed_lines(docs, min_chars).repartition("range", "slice")
    run = ["range", "slice", "h1", "h2"]
    streamed = Window.partitionBy(*run).orderBy(F.col("doc_id").desc_nulls_last(), "version", "position")
    previous = F.lag(F.struct("doc_id")).over(streamed)
    first = previous.isNull() | ~previous["doc_id"].eqNullSafe(F.col("doc_id"))
    runs = (
        placed.withColumn("first", first)
        .where("first")
        .groupBy(*run)
        .agg(F.count("*").alias("docs"), F.max(F.struct("doc_id")).alias("last"))
    )
    whole = Window.partitionBy("h1", "h2")  # at most SLICES rows
    shared = (
        runs.withColumns({"all_docs": F.sum("docs").over(whole), "keeper": F.max("last").over(whole)})
        .where(F.col("all_docs") >= min_docs)
        .select(*[F.col(c).alias(f"s_{c}") for c in run], "keeper")
    )
    # Ranges are so narrow that equal ranges nearly always mean equal hashes. Comparing the hashes inside the
    # join leaves range and slice as its keys, by which the lines are partitioned already.
    equal = (
        (F.col("range") == F.col("s_range"))
        & (F.col("slice") == F.col("s_slice"))
        & (F.col("h1").bitwiseXOR(F.col("s_h1")) == 0)
        & (F.col("h2").bitwiseXOR(F.col("s_h2")) == 0)
    )
    found = placed.join(shared, equal)
    return found.where(~F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))).select("doc_id", "version", "position")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document that loses lines: doc_id, version, n_dropped and bitmap, a map from the number of a
    64-bit word to the word; bit p % 64 of word p / 64 is set if line p goes."""
    gone = dropped_lines(docs, min_chars, min_docs).distinct()
    words = (
        gone.withColumns({"word": F.floor(F.col("position") / 64).cast("int"), "bit": _shifted(F.pmod("position", F.lit(64)))})
        .groupBy("doc_id", "version", "word")
        .agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    )
    return words.groupBy("doc_id", "version").agg(
        F.sum("n").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap")
    )


def _shifted(places: Column) -> Column:
    """1 << places as a bigint."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), places.cast("int"))


def kept_lines(text: Column, bitmap: Column) -> Column:
    """The lines of a text whose bit is not set."""

    def stays(_line: Column, place: Column) -> Column:
        word = F.coalesce(F.element_at(bitmap, F.floor(place / 64).cast("int")), F.lit(0).cast("bigint"))
        return word.bitwiseAND(_shifted(F.pmod(place, F.lit(64)))) == 0

    return F.when(bitmap.isNull(), lines(text)).otherwise(F.filter(lines(text), stays))


def with_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with columns _n_dropped and _bitmap (null where no line goes)."""
    maps = drop_bitmaps(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("_b_id"), F.col("version").alias("_b_version"),
        F.col("n_dropped").alias("_n_dropped"), F.col("bitmap").alias("_bitmap"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_b_id")) & (text_hash(F.col("text")) == F.col("_b_version"))
    return docs.join(maps, same, "left").drop("_b_id", "_b_version")


def deduplicate(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the lines gone from their texts; n_chars follows the text where there is one.
    A null text stays null."""
    found = with_bitmaps(docs, min_chars, min_docs)
    text = F.when(F.col("_bitmap").isNull(), F.col("text")).otherwise(
        F.array_join(kept_lines(F.col("text"), F.col("_bitmap")), "\n")
    )
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
