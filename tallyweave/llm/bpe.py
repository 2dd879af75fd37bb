"""Byte-level BPE, encoding and decoding, by recursive DuckDB queries inside every partition.

A text is split by the pattern of the vocabulary. The different words of a batch go, as rows (word, position, token) that start
with single bytes, into one recursive query: neighbouring tokens are joined with the table of merges, every word finds its
least rank, and the pairs of that rank are contracted from the left; words without a pair leave the recursion. A word that is a
token itself is that token. Decoding joins the ids with the vocabulary and puts the bytes together by an ordered aggregate.

In words of more than ``SHORT`` characters several pairs are contracted in one step where this is the same as one after the
other: no merge that uses the new token has a lower rank, and the pairs share no token. So a long word needs about as many
steps as it has different merges.

The database is one of the worker's own memory, with one thread and no folder to spill to. What goes in at once is bounded by
``SLICE_CHARS`` and ``SLICE_IDS``, whatever the size of a text (one word without any break goes in whole).

Defined cases: a null or empty text has no ids, and no ids decode to no bytes; a null list of ids decodes to no bytes, an id
that is not in the vocabulary is an error. Repeated rows and equal ids are rows of their own, an empty table gives an empty
result, and columns other than those named are not looked at.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tallyweave.llm.frames import map_batches

#: Characters of words, and ids, that one query takes, or a word more.
SLICE_CHARS, SLICE_IDS = 500_000, 500_000
#: Words of so many characters go pair by pair, longer ones by all pairs of a rank.
SHORT = 40
#: Characters of text whose words are held at once: the more, the fewer words come up again.
HELD_CHARS = 8_000_000
#: Ids of so many different words are kept per worker, as Arrow arrays of some 40 bytes a word.
KEPT_WORDS = 1_500_000
#: Rows that go back to Spark together.
OUT_ROWS = 1_000

SETTINGS = {"threads": 1, "temp_directory": "", "memory_limit": "1GB"}

#: Every way to put a token together from two. ``at_once``: no merge with this token as a part has a lower rank.
MERGES = """
CREATE TABLE merges AS
WITH cuts AS (SELECT id, hex, unnest(range(2, length(hex), 2)) AS cut FROM vocabulary),
pairs AS (
    SELECT a.id AS first, b.id AS second, c.id FROM cuts c
    JOIN vocabulary a ON a.hex = substr(c.hex, 1, c.cut) JOIN vocabulary b ON b.hex = substr(c.hex, c.cut + 1)
),
uses AS (
    SELECT part, min(id) AS least FROM (SELECT first AS part, id FROM pairs UNION ALL SELECT second, id FROM pairs) GROUP BY part
)
SELECT p.*, coalesce(u.least > p.id, true) AS at_once FROM pairs p LEFT JOIN uses u ON u.part = p.id
"""

#: word, ids of every row (word, hex) of ``words``. Rows of ``steps`` whose token is null were contracted into the one before.
_ENCODE = """
WITH RECURSIVE whole AS (SELECT w.word, v.id FROM words w JOIN vocabulary v USING (hex)),
singles AS (
    SELECT p.word, p.pos, v.id
    FROM (SELECT word, hex, unnest(range(length(hex) // 2)) AS pos FROM words WHERE word NOT IN (SELECT word FROM whole)) p
    JOIN vocabulary v ON v.hex = substr(p.hex, 2 * p.pos + 1, 2)
),
steps(word, pos, token) USING KEY (word, pos) AS (
    SELECT word, pos, id FROM singles
  UNION ALL (
    WITH neighbours AS (
        SELECT word, pos, token, lead(token) OVER places AS next_token, lead(pos) OVER places AS next_pos
        FROM steps WHERE token IS NOT NULL WINDOW places AS (PARTITION BY word ORDER BY pos)
    ),
    {step}  )
)
SELECT word, list(token ORDER BY pos) AS ids FROM steps WHERE token IS NOT NULL GROUP BY word
UNION ALL
SELECT word, [id] FROM whole
"""

#: The leftmost pair of the least rank of every word.
_ONE_PAIR = """
    least AS (
        SELECT n.word, min(m.id::BIGINT << 32 | n.pos) AS low, arg_min(n.next_pos, m.id::BIGINT << 32 | n.pos) AS gone
        FROM neighbours n JOIN merges m ON m.first = n.token AND m.second = n.next_token GROUP BY n.word
    )
    SELECT s.word, s.pos, CASE s.pos WHEN l.low & 4294967295 THEN (l.low >> 32)::INT WHEN l.gone THEN NULL ELSE s.token END
    FROM steps s JOIN least l USING (word) WHERE s.token IS NOT NULL
"""
#: All pairs of the least rank from the left, where that is the same as one after the other; for long words.
_ALL_PAIRS = """
    joined AS (
        SELECT n.word, n.pos, n.next_pos, m.id, m.at_once
        FROM neighbours n JOIN merges m ON m.first = n.token AND m.second = n.next_token
    ),
    least AS (SELECT word, min(id) AS id FROM joined GROUP BY word),
    found AS (
        SELECT j.word, j.pos, j.next_pos, j.id, j.at_once, row_number() OVER places AS nth,
            lag(j.next_pos) OVER places IS NOT DISTINCT FROM j.pos AS shares
        FROM joined j JOIN least USING (word, id) WINDOW places AS (PARTITION BY j.word ORDER BY j.pos)
    ),
    runs AS (
        SELECT *, nth - max(CASE WHEN NOT shares THEN nth END) OVER (PARTITION BY word ORDER BY pos) AS place_in_run FROM found
    ),
    taken AS (SELECT word, pos, next_pos, id FROM runs WHERE nth = 1 OR at_once AND place_in_run % 2 = 0),
    changes AS (SELECT word, pos, id FROM taken UNION ALL SELECT word, next_pos, NULL FROM taken)
    SELECT s.word, s.pos, CASE WHEN c.word IS NULL THEN s.token ELSE c.id END
    FROM steps s JOIN least USING (word) LEFT JOIN changes c ON c.word = s.word AND c.pos = s.pos
    WHERE s.token IS NOT NULL
"""
ENCODE, ENCODE_LONG = _ENCODE.format(step=_ONE_PAIR), _ENCODE.format(step=_ALL_PAIRS)

#: text, bytes of every row (text, pos, id) of ``tokens``; strange: ids that are not in the vocabulary.
DECODE = """
SELECT text, unhex(string_agg(v.hex, '' ORDER BY pos)) AS bytes, count(*) - count(v.hex) AS strange
FROM tokens t LEFT JOIN vocabulary v USING (id) GROUP BY text
"""

#: A single space between other characters: no word of the pattern reaches over it.
_CUT = re.compile(r"\S(?= \S)")
#: White space that a cut at every single space could tear apart.
_LOOSE = re.compile(r"\s (?:\s|\Z)|  ")
_NOTHING, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


def vocabulary_files() -> tuple[str, str]:
    """(ranks, split pattern) of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Coder:
    """Encodes and decodes with one vocabulary, in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb  # in the workers only: the driver needs none

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing}")
        self.pattern = regex.compile(pattern)
        self.kept, self.kept_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.db = duckdb.connect(":memory:", config=SETTINGS)
        tokens = pa.table({"hex": [t.hex().upper() for t in ranks], "id": pa.array(ranks.values(), pa.int32())})
        self._run("CREATE TABLE vocabulary AS SELECT * FROM tokens", tokens=tokens)
        self.db.execute(MERGES)

    def _run(self, query: str, **tables: pa.Table) -> pa.Table | None:
        for name, rows in tables.items():
            self.db.register(name, rows)
        try:
            found = self.db.sql(query)
            return found if found is None else found.to_arrow_table()
        finally:
            for name in tables:
                self.db.unregister(name)

    def words(self, texts: Iterable[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of every different word, a slice at a time."""
        found: dict[str, bytes] = {}
        short, long = [], []
        for word in dict.fromkeys(texts):
            (short if len(word) <= SHORT else long).append(word)
        for query, chosen in ((ENCODE, short), (ENCODE_LONG, long)):
            for part in _slices(chosen, SLICE_CHARS):
                rows = pa.table({"word": pa.array(range(len(part)), pa.int32()), "hex": [w.encode().hex().upper() for w in part]})
                for chunk in self._run(query, words=rows).to_batches():
                    lists = chunk.column(1)
                    raw = np.asarray(lists.values).astype("<u4").tobytes()
                    ends = lists.offsets.to_pylist()
                    for word, start, stop in zip(chunk.column(0).to_pylist(), ends, ends[1:]):
                        found[part[word]] = raw[4 * start : 4 * stop]
        return found

    def _known(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of different pieces; a piece is a word or several that follow each other without a space."""
        at = pc.index_in(pieces, value_set=self.kept)
        new = pieces.filter(pc.is_null(at))
        words = [self.pattern.findall(piece) for piece in new.to_pylist()]
        ids = self.words(w for found in words for w in found)
        fresh = pa.array([b"".join([ids[w] for w in found]) for found in words], pa.large_binary())
        at = np.array(pc.fill_null(at, -1))
        at[at < 0] = len(self.kept) + np.arange(len(new))
        out = pa.concat_arrays([self.kept_ids, fresh]).take(pa.array(at))
        room = max(0, KEPT_WORDS - len(self.kept))
        self.kept = pa.concat_arrays([self.kept, new[:room]])
        self.kept_ids = pa.concat_arrays([self.kept_ids, fresh[:room]])
        return out

    def _held(self, stretches: list[str]) -> list[bytes]:
        """Ids of every stretch. Those without loose white space are divided at spaces, which go with the piece after them."""
        loose = [i for i, text in enumerate(stretches) if _LOOSE.search(text)]
        found = [self.pattern.findall(stretches[i]) for i in loose]
        firm = sorted(set(range(len(stretches))).difference(loose))
        parts = pc.split_pattern(pa.array([stretches[i] for i in firm], pa.large_string()), " ")
        heads = np.asarray(parts.offsets)[:-1]
        spaced, plain = parts.values.dictionary_encode(), pa.array([w for words in found for w in words], pa.large_string())
        plain = pa.concat_arrays([parts.values.take(pa.array(heads)), plain]).dictionary_encode()
        after_space = pc.binary_join_element_wise(_NOTHING, spaced.dictionary.cast(pa.large_string()), _SPACE)
        ids = self._known(pa.concat_arrays([after_space, plain.dictionary.cast(pa.large_string())]))
        codes, plain_codes = np.array(spaced.indices, dtype=np.int64), np.asarray(plain.indices).astype(np.int64) + len(spaced.dictionary)
        codes[heads] = plain_codes[: len(heads)]
        joined = ids.take(pa.array(np.concatenate([codes, plain_codes[len(heads) :]])))
        _, offsets, data = joined.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[: len(joined) + 1]
        data = memoryview(data) if data else b""
        ends = np.concatenate([np.asarray(parts.offsets), len(codes) + np.cumsum([len(words) for words in found], dtype=np.int64)])
        out = [b""] * len(stretches)
        for k, i in enumerate([*firm, *loose]):
            out[i] = bytes(data[offsets[ends[k]] : offsets[ends[k + 1]]])
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = []
        held: list[str] = []
        of: list[int] = []
        chars = 0

        def empty() -> None:
            for i, ids in zip(of, self._held(held)):
                out[i].append(ids)

        for i, text in enumerate(texts):
            out.append([])
            for stretch in _stretches(text or "", HELD_CHARS):
                held.append(stretch)
                of.append(i)
                chars += len(stretch)
                if chars >= HELD_CHARS:
                    empty()
                    held, of, chars = [], [], 0
        if held:
            empty()
        return [b"".join(x) for x in out]

    def decode(self, lists: Iterable[bytes | None]) -> list[bytes]:
        """Bytes of every list of ids."""
        out, held, count = [], [], 0
        for i, raw in enumerate(lists):
            ids = np.frombuffer(raw or b"", dtype="<u4")
            out.append(bytearray())
            for start in range(0, len(ids), SLICE_IDS):
                held.append((i, ids[start : start + SLICE_IDS]))
                count += len(held[-1][1])
                if count >= SLICE_IDS:
                    self._decoded(held, out)
                    held, count = [], 0
        self._decoded(held, out)
        return [bytes(x) for x in out]

    def _decoded(self, held: list[tuple[int, np.ndarray]], out: list[bytearray]) -> None:
        if not held:
            return
        ids = np.concatenate([x for _, x in held])
        text = np.repeat(np.array([i for i, _ in held], dtype=np.int32), [len(x) for _, x in held])
        tokens = pa.table({"text": text, "pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int64)})
        result = self._run(DECODE, tokens=tokens)
        for i, raw, strange in zip(*(result.column(k).to_pylist() for k in range(3))):
            if strange:
                raise ValueError(f"{strange} ids are not in the vocabulary")
            out[i] += raw


def _slices(words: Iterable[str], size: int) -> Iterator[list[str]]:
    part, held = [], 0
    for word in words:
        part.append(word)
        held += len(word)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _stretches(text: str, size: int) -> Iterator[str]:
    """A text in stretches of ``size`` characters or a little more, cut where no word reaches over."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    if start < len(text):
        yield text[start:]


@cache
def coder(path: str, pattern: str) -> Coder:
    """The coder of this worker."""
    return Coder(read_ranks(path), pattern)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``HELD_CHARS`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= HELD_CHARS:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _mapped(df: DataFrame, source: str, steps: tuple[str, ...], files: tuple[str, str] | None) -> DataFrame:
    """``df`` with a binary column for every step: encode, decode, or the one after the other in the same worker."""
    path, pattern = files or vocabulary_files()
    names = {"encode": "ids", "decode": "decoded"}
    kept = [f for f in df.schema.fields if f.name not in {source, *[names[s] for s in steps]}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in _gathered(batches):
            values = batch.column(len(kept)).to_pylist()
            columns = list(batch.columns[: len(kept)])
            for step in steps:
                values = getattr(own, step)(values)
                columns.append(pa.array(values, pa.binary()))
            out = pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [names[s] for s in steps])
            for start in range(0, out.num_rows, OUT_ROWS):
                yield out.slice(start, OUT_ROWS)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{names[s]} binary" for s in steps])
    return map_batches(df.select(*[f"`{f.name}`" for f in kept], source), run, schema)


def encode(docs: DataFrame, text: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit numbers) in place of the text."""
    return _mapped(docs, text, ("encode",), files)


def decode(tokens: DataFrame, ids: str = "ids", files: tuple[str, str] | None = None) -> DataFrame:
    """``tokens`` with ``decoded`` (the bytes of the text) in place of the ids."""
    return _mapped(tokens, ids, ("decode",), files)


def recode(docs: DataFrame, text: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` and what they decode to in place of the text; a worker does both, so ids move once."""
    return _mapped(docs, text, ("encode", "decode"), files)
