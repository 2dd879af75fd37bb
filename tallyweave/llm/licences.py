"""Licence scans by canonical digest lookup.

Texts are made canonical: lower case, punctuation and white space as single spaces, copyright lines left out,
equivalent spellings made one. Whole texts are then looked up by their digest in a table of known licences, in a
hash join with a table of fixed size. Every line is looked up too, among the known short notices.

Native: DataFrame functions only, one pass over the texts, no shuffle.

Defined cases: a null text is an empty one; texts that are empty when canonical have no licence; repeated rows are
scanned each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.known_licences import NOTICES, TEXTS

#: ASCII control and punctuation characters but the line feed, no-break spaces, typographic quotes and dashes, ©.
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x20!-/:-@\\[-`{-\\x7F ©‐-―‘-‟…]+"
#: Spellings and what they become, one after the other.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("https", "http"),
)
COPYRIGHT = r"^(copyright( c)? |c )[0-9]{4}|^copyright( c)? (by )?(the )?[^ ]*( authors| holders)?$|^all rights reserved$"


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without copyright lines and empty ones."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " ")
    for spelling, common in SPELLINGS:
        spaced = F.replace(spaced, F.lit(spelling), F.lit(common))
    lines = F.transform(F.split(spaced, "\n", -1), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~line.rlike(COPYRIGHT))


def canonical(text: Column) -> Column:
    """A whole text in canonical form, on one line."""
    return F.array_join(canonical_lines(text), " ")


def known(docs: DataFrame, licences: Sequence[tuple[str, str]]) -> DataFrame:
    """license and digest of known texts; a fixed table."""
    rows = docs.sparkSession.createDataFrame(list(licences), "license string, body string")
    return rows.select("license", F.sha2(canonical(F.col("body")).cast("binary"), 256).alias("known_digest"))


def scan(
    docs: DataFrame, texts: Sequence[tuple[str, str]] = TEXTS, notices: Sequence[tuple[str, str]] = NOTICES
) -> DataFrame:
    """doc_id, digest (of the canonical text), license (of the whole text, or null), notices (the licences that single
    lines name, sorted, joined by commas) and n_notices of every document."""
    found = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    by_line = F.create_map(*[x for name, body in notices for x in (canonical(F.lit(body)), F.lit(name))])
    named = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda l: F.try_element_at(by_line, l)), lambda n: n.isNotNull())))
    found = found.select(
        "doc_id", F.sha2(F.array_join("lines", " ").cast("binary"), 256).alias("digest"), named.alias("named")
    )
    whole = F.broadcast(known(docs, [*texts, *notices]))
    return found.join(whole, F.col("digest") == F.col("known_digest"), "left").select(
        "doc_id", "digest", "license", F.array_join("named", ",").alias("notices"), F.size("named").cast("bigint").alias("n_notices")
    )
