"""N-gram Jaccard join: documents whose word shingles overlap, and the groups that they form.

A document is the set of its distinct shingles. Two link when their Jaccard similarity reaches the threshold
(a whole percentage, compared in integers). No link is lost:

* Frequent shingles are found first: counts of a fixed part of all shingles (by hash), summed over all documents. They fix
  an order of all shingles, rare ones first. Two sets that link share a shingle among the first of each
  (set size - least overlap + 1), so documents meet only through these.
* Documents that share such a shingle make a group. First each is compared with the group's smallest id, which needs
  as many pairs as there are rows. What that links is one component already; near copies by the thousand are.
* Groups that still hold several components are cut into tiles by size: rows outside the largest component (the home)
  against all rows. Pairs within a component are passed over; sizes, the place of the shingle and, in large groups, bitmaps
  bound the overlap from above before a pair leaves its tile.
* In large groups this takes two rounds: first only scouts look, a part of the rows outside (by hash). What they link makes
  larger components, so that few rows are left outside for the second round, in which all others look. A loose group, whose
  members link with some of the others only, so gives pairs for its scouts instead of for all its rows.
* Every pair is held against bitmaps of hashed shingles (four bits per shingle, widths in powers of two, by size
  band): bits that only one side has bound the overlap from above. The rest is decided by the intersection of the two
  sorted arrays of shingles, taken from the whole texts.

Shingles are compared by 64-bit hashes. Exact copies link by a 128-bit digest of their arrays.

Defined cases: a null text, or one without words, has the empty set and links with nothing; fewer words than a
shingle make one shingle; rows with one id are versions of one document, which has the links of all of them; a null id
takes no part and its component is null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm import textcols
from tallyweave.llm.components import components
from tallyweave.llm.frames import map_arrow, map_batches
from tallyweave.session import stored


@dataclass(frozen=True)
class Join:
    """width: words of a shingle; percent: least similarity. hot_docs: documents from which a shingle is frequent;
    most_hot bounds how many frequent shingles are told apart (the threshold is raised to it, which costs time, not links);
    small: rows of a group up to which bitmaps are not sent along; side: rows of a side of a tile;
    scouts: one in so many rows outside the home of a large group looks for links before the others;
    broadcast_rows: tables of ids up to which they are broadcast instead of shuffled."""

    width: int = 5
    percent: int = 80
    hot_docs: int = 8
    most_hot: int = 1 << 21
    small: int = 64
    side: int = 1024
    scouts: int = 8
    broadcast_rows: int = 100_000

    def least(self, n: np.ndarray) -> np.ndarray:
        """Overlap that a set of size n needs with any partner."""
        return -(-self.percent * n // 100)

    def reached(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (n + m - common)


#: Of eight equal parts of the hash space, so many are counted to find frequent shingles.
COUNTED, EIGHTHS = 3, 8
#: Text whose shingles are counted together before they are sent.
COUNT_BYTES = 4 << 20
EMPTY = np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted array of shingle hashes of every text."""
    for _, part in textcols.slices(column):
        found = textcols.words(part)
        hashes = found.hashes(fold_ascii=True)
        grams, at = textcols.windows(hashes, found.rows, width)
        bounds = np.searchsorted(found.rows[at], np.arange(len(part) + 1)) if len(at) else np.zeros(len(part) + 1, int)
        for i in range(len(part)):
            few = hashes[found.firsts[i] : found.firsts[i + 1]]
            if len(few) >= width:
                yield np.unique(grams[bounds[i] : bounds[i + 1]])
            elif len(few):
                # The whole sequence is the shingle; its length keeps it apart from those of full width.
                yield textcols.windows(few, np.zeros(len(few), int), len(few), seed=len(few))[0]
            else:
                yield EMPTY


def counted(tokens: np.ndarray) -> np.ndarray:
    """Which tokens belong to the part of the hash space that is counted."""
    return (tokens >> np.uint64(61)).astype(np.int64) < COUNTED


#: Counted tokens are known by the 40 bits below the topmost three.
def short(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(21)) & np.uint64((1 << 40) - 1)


def frequent(docs: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(shortened tokens, rising; classes) of the frequent shingles: the class is the log2 of the documents."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = join.width

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def leave() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # Ranges of equal width, as hashes are uniform.
            part = (tokens * np.uint64(parts) >> np.uint64(40)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            five = tokens.view(np.uint8).reshape(-1, 8)[:, :5]
            some = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
            many = [np.flatnonzero(counts[cuts[k] : cuts[k + 1]] > 1).astype(np.uint32) for k in some]
            more = [counts[cuts[k] : cuts[k + 1]][m].astype(np.uint32) for k, m in zip(some, many)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([five[cuts[k] : cuts[k + 1]].tobytes() for k in some]),
                    pa.array([m.tobytes() for m in many]),
                    pa.array([m.tobytes() for m in more]),
                ],
                names=["part", "tokens", "many", "counts"],
            )

        for batch in batches:
            for tokens in shingle_sets(batch.column(0), width):
                mine = short(tokens[counted(tokens)])
                held.append(mine)
                size += 8 * len(mine)
                if size >= COUNT_BYTES:
                    yield leave()
                    size = 0
        if size:
            yield leave()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, packed, many, counts in zip(*[c.to_pylist() for c in batch.columns]):
                wide = np.zeros((len(packed) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
                n = np.ones(len(wide), np.int64)
                n[np.frombuffer(many, np.uint32)] = np.frombuffer(counts, np.uint32)
                by_part.setdefault(part, []).append((wide.view(np.uint64).ravel(), n))
        for found in by_part.values():
            tokens, n = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(tokens, kind="stable")
            tokens, n = tokens[order], n[order]
            heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            total = np.add.reduceat(n, heads)
            hot = total >= join.hot_docs
            if hot.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[heads][hot].astype(np.int64)), pa.array(np.log2(total[hot]).astype(np.int32))],
                    names=["token", "class"],
                )

    sent = map_batches(docs.select("text"), collect, "part int, tokens binary, many binary, counts binary")
    found = stored(map_batches(sent.repartition(parts, "part"), add_up, "token bigint, class int"), "frequent")
    room, lowest = join.most_hot, 64
    for row in found.groupBy("class").count().orderBy(F.desc("class")).collect():  # at most 64 rows
        room -= row["count"]
        if room < 0:
            break
        lowest = row["class"]
    rows = found.where(F.col("class") >= lowest).toArrow()  # at most most_hot rows
    tokens, classes = np.asarray(rows["token"]).astype(np.uint64), np.asarray(rows["class"]).astype(np.int16)
    del rows
    pa.default_memory_pool().release_unused()
    order = np.argsort(tokens)
    return tokens[order], classes[order]


def prefix(tokens: np.ndarray, hot: np.ndarray, classes: np.ndarray, join: Join) -> np.ndarray:
    """The first tokens of a set, rare ones first: counted and not frequent, then not counted, then frequent ones."""
    n = len(tokens)
    order = np.ones(n, np.int16)
    mine = np.flatnonzero(counted(tokens))
    order[mine] = 0
    if len(hot) and len(mine):
        wanted = short(tokens[mine])
        at = np.minimum(np.searchsorted(hot, wanted), len(hot) - 1)
        met = hot[at] == wanted
        order[mine[met]] = 2 + classes[at[met]]
    keep = n - int(join.least(np.int64(n))) + 1
    return tokens[np.argsort(order, kind="stable")[:keep]]


def bitmap(tokens: np.ndarray) -> bytes:
    """Four bits per token at least, in a power of two (64 to 65,536 bits)."""
    bits = min(max(64, 1 << (4 * len(tokens) - 1).bit_length()), 1 << 16)
    marks = np.zeros(bits, bool)
    marks[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap at a smaller power of two."""
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def overlap_bound(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """The largest overlap that two bitmaps (64-bit words) leave possible."""
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def described(docs: DataFrame, join: Join, hot: np.ndarray, classes: np.ndarray) -> DataFrame:
    """doc_id, n, d1 and d2 (digest), bitmap and prefix of every document, stored."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast((hot, classes))
    names = ["doc_id", "n", "d1", "d2", "bitmap", "prefix"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hot, classes = known.value
        n, d1, d2, maps, firsts, ends = [], [], [], [], [], [0]
        for tokens in shingle_sets(batch.column(1), join.width):
            n.append(len(tokens))
            mixed = textcols.mix(tokens + np.uint64(17))
            d1.append(np.bitwise_xor.reduce(mixed) if len(tokens) else np.uint64(0))
            d2.append(np.add.reduce(textcols.mix(mixed)) if len(tokens) else np.uint64(0))
            maps.append(bitmap(tokens))
            firsts.append(prefix(tokens, hot, classes, join) if len(tokens) else EMPTY)
            ends.append(ends[-1] + len(firsts[-1]))
        flat = np.concatenate(firsts).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(np.array(d1, np.uint64).view(np.int64)),
                pa.array(np.array(d2, np.uint64).view(np.int64)),
                pa.array(maps, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ],
            names=names,
        )

    schema = f"doc_id {ids}, n bigint, d1 bigint, d2 bigint, bitmap binary, prefix array<bigint>"
    found = stored(map_arrow(docs.select("doc_id", "text"), run, schema), "sets")
    known.destroy()  # what comes later starts from the files
    return found


def _marked(df: DataFrame, rows: int, join: Join) -> DataFrame:
    return F.broadcast(df) if rows <= join.broadcast_rows else df


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that link."""
    info = sets.select("doc_id", "n", "d1", "d2", "bitmap")

    def side(name: str) -> DataFrame:
        return info.select(*[F.col(c).alias(f"{c}_{name}") for c in info.columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with_b = pairs.join(side("b"), F.col("b") == F.col("doc_id_b"))
    both = with_b.join(side("a"), F.col("a") == F.col("doc_id_a"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = both.where((small > 0) & (100 * small >= join.percent * large))
    equal = (F.col("d1_a") == F.col("d1_b")) & (F.col("d2_a") == F.col("d2_b")) & (F.col("n_a") == F.col("n_b"))
    rows = both.select("a", "b", "n_a", "n_b", equal.alias("sure"), "bitmap_a", "bitmap_b")

    def bound(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, m, sure = (np.asarray(batch.column(k)) for k in (2, 3, 4))
        most = np.empty(len(n), np.int64)
        for i, (x, y) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())):
            most[i] = overlap_bound(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n[i], m[i])
        keep = pa.array(sure | join.reached(most, n, m))
        yield batch.select([0, 1, 4]).filter(keep)

    left = stored(map_arrow(rows, bound, f"a {kind}, b {kind}, sure boolean"), "bounded")
    open_pairs = left.where("not sure").select("a", "b").distinct()
    wanted = open_pairs.select("a").union(open_pairs.select("b")).distinct().withColumnRenamed("a", "w")
    wanted = stored(wanted, "wanted")
    texts = docs.select("doc_id", "text").join(
        _marked(wanted, wanted.count(), join), F.col("doc_id") == F.col("w"), "left_semi"
    )
    texts_b = texts.select(F.col("doc_id").alias("id_b"), F.col("text").alias("text_b"))
    texts_a = texts.select(F.col("doc_id").alias("id_a"), F.col("text").alias("text_a"))
    read = open_pairs.join(texts_b, F.col("b") == F.col("id_b")).join(texts_a, F.col("a") == F.col("id_a"))

    def decide(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        # Rows come sorted by a: each of its texts is read once per run.
        new = [i == 0 or ids[i] != ids[i - 1] or batch.column(2)[i] != batch.column(2)[i - 1] for i in range(len(ids))]
        run = np.cumsum(new) - 1
        ours = list(shingle_sets(batch.column(2).filter(pa.array(new)), join.width))
        keep = []
        for i, theirs in enumerate(shingle_sets(batch.column(3), join.width)):
            mine = ours[run[i]]
            common = len(np.intersect1d(mine, theirs, assume_unique=True))
            keep.append(len(mine) > 0 and bool(join.reached(common, len(mine), len(theirs))))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    linked = map_arrow(read.select("a", "b", "text_a", "text_b"), decide, f"a {kind}, b {kind}")
    return stored(left.where("sure").select("a", "b").union(linked).distinct(), "verified")


def _fits(join: Join, n: np.ndarray, m: np.ndarray, at: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sizes n, m can link, and could do so if the tokens at places at, bt were the first they share."""
    most = 1 + np.minimum(n - at - 1, m - bt - 1)
    # Places count along the common order; behind the prefix lie the other tokens of the set.
    return (100 * np.minimum(n, m) >= join.percent * np.maximum(n, m)) & join.reached(most, n, m)


def small_group_pairs(rows: DataFrame, join: Join, kind: str) -> DataFrame:
    """Candidate pairs inside groups of at most ``small`` rows (token, doc_id, n, place, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            token, n, place, comp = (np.asarray(t[k]) for k in ("token", "n", "place", "component"))
            ids = t["doc_id"].combine_chunks() if t["doc_id"].num_chunks != 1 else t["doc_id"].chunk(0)
            left, right = [], []
            for s in range(1, len(token)):
                i = np.flatnonzero(token[:-s] == token[s:])
                if not len(i):
                    break
                j = i + s
                ok = (comp[i] != comp[j]) & _fits(join, n[i], n[j], place[i], place[j])
                left.append(i[ok])
                right.append(j[ok])
            i = np.concatenate(left) if left else np.zeros(0, int)
            j = np.concatenate(right) if right else np.zeros(0, int)
            # Two documents often share many tokens; those of a center come together.
            found = pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))}).group_by(["a", "b"]).aggregate([])
            columns = [found[k].combine_chunks() for k in ("a", "b")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in columns]
            if not len(found):
                columns = [ids.slice(0, 0)] * 2
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            token = np.asarray(t["token"])
            last = np.flatnonzero(token != token[-1])  # the last group may go on
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield pairs(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield pairs(rest)

    cols = rows.select("token", "doc_id", "n", "place", "component", "center")
    sorted_ = cols.repartition("center").sortWithinPartitions("center", "token").drop("center")
    found = map_batches(sorted_, run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def tile_pairs(rows: DataFrame, sets: DataFrame, join: Join, kind: str) -> DataFrame:
    """Candidate pairs of large groups. Rows that are ``apart`` meet all rows of their groups.

    The groups of one center have much the same documents, as near copies share most of their tokens. So a document goes to
    the tiles of a center once, with one bitmap and the list of its tokens there. Tiles hold at most about ``side`` rows
    a side; sizes order the rows, so tiles out of reach are empty."""
    maps = sets.select(F.col("doc_id").alias("m_id"), "bitmap")
    rows = rows.groupBy("center", "doc_id", "n", "component").agg(
        F.collect_list(F.struct("token", "place", "apart")).alias("tokens"), F.max("apart").alias("looks")
    )
    # Size bands: two sizes whose ratio allows a link lie in one band or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / join.percent))).cast("int")
    rows = stored(rows.withColumn("band", band), "tiles")
    per = rows.groupBy("center", "band").agg(
        F.count("*").alias("rows"), F.sum(F.col("looks").cast("bigint")).alias("outside")
    )
    blocks = stored(
        per.select(
            F.col("center").alias("t"), F.col("band").alias("band_all"),
            F.ceil(F.col("rows") / join.side).cast("int").alias("blocks"), F.ceil(F.col("outside") / join.side).cast("int").alias("outer"),
        ),
        "blocks",
    )
    rows = rows.join(maps, F.col("doc_id") == F.col("m_id")).drop("m_id")
    # A row that stands apart looks at its own band and both neighbours; every row is looked at from the same three.
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    hashed = F.xxhash64("doc_id")

    def beside(side: DataFrame, key: str, *found: str) -> DataFrame:
        wanted = blocks.select("t", "band_all", *found)
        return side.join(wanted, (F.col("center") == F.col("t")) & (F.col(key) == F.col("band_all"))).drop("t", "band_all")

    cols = ["doc_id", "n", "component", "tokens", "bitmap"]
    looking = beside(rows.where("looks").withColumn("over", near), "over", "blocks")
    looking = beside(looking.withColumn("from", F.col("band")), "from", "outer").select(
        "center", "from", "over", F.pmod(hashed, F.col("outer")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), *cols, F.lit(1).alias("looking"),
    )
    seen = beside(rows.withColumn("from", near), "from", "outer").where("outer > 0")
    seen = beside(seen.withColumn("over", F.col("band")), "over", "blocks").select(
        "center", "from", "over", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"),
        F.pmod(hashed, F.col("blocks")).cast("int").alias("j"), *cols, F.lit(0).alias("looking"),
    )
    key = ["center", "from", "over", "i", "j"]
    tiles = looking.union(seen)

    def tile(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        looks = np.asarray(t["looking"]) == 1
        n, comp = np.asarray(t["n"]), np.asarray(t["component"])
        ids, lists, maps = (t[k].chunk(0) for k in ("doc_id", "tokens", "bitmap"))
        left, right = [EMPTY.astype(np.int64)], [EMPTY.astype(np.int64)]
        if looks.any() and not looks.all():
            words = [np.frombuffer(b.as_py(), np.uint64) for b in maps]
            size = min(map(len, words))
            bits = np.stack([folded(w, size) for w in words])
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            row, entries = np.repeat(np.arange(len(ids)), np.diff(ends)), lists.flatten()
            token, place = (np.asarray(entries.field(k)) for k in (0, 1))
            apart = np.asarray(entries.field(2).cast(pa.int8())) == 1
            shown = np.flatnonzero(~looks[row])
            shown = shown[np.argsort(token[shown], kind="stable")]
            sorted_tokens = token[shown]
            for i in np.flatnonzero(looks):
                own = np.arange(ends[i], ends[i + 1])
                own = own[apart[own]]
                starts = np.searchsorted(sorted_tokens, token[own])
                counts = np.searchsorted(sorted_tokens, token[own], side="right") - starts
                mine = np.repeat(own, counts)
                theirs = shown[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
                j = row[theirs]
                j = np.unique(j[(comp[j] != comp[i]) & _fits(join, n[j], n[i], place[theirs], place[mine])])
                if not len(j):
                    continue
                most = np.minimum(
                    n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64),
                    n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64),
                )
                j = j[join.reached(most, n[i], n[j])]
                left.append(np.full(len(j), i))
                right.append(j)
        columns = [ids.take(pa.array(np.concatenate(x))) for x in (left, right)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows of the last tile met
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys = [np.asarray(t[k]) for k in key]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1), len(t)]
            goes_on = bool(held) and all(held[-1][k][-1] == t[k][0] for k in key)
            if held and not goes_on:
                yield tile(pa.concat_tables(held))
                held = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                held.append(t.slice(a, b - a))
                if b < len(t):
                    yield tile(pa.concat_tables(held))
                    held = []
        if held:
            yield tile(pa.concat_tables(held))

    found = map_batches(tiles.repartition(*key).sortWithinPartitions(*key), run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _reachable(n: Column, place: Column, m: Column, m_place: Column, join: Join) -> Column:
    """The bounds of ``_fits``, on columns."""
    most = F.least(n - place, m - m_place)
    return (100 * F.least(n, m) >= join.percent * F.greatest(n, m)) & (100 * most >= join.percent * (n + m - most))


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with a component: that of ``labels`` (l_id, label) under ``key``, else the key itself."""
    found = rows.join(labels, F.col(key) == F.col("l_id"), "left")
    return found.withColumn("component", F.coalesce("label", key)).drop("l_id", "label")


def _unsettled(rows: DataFrame, name: str) -> DataFrame:
    """Rows of groups with several components, and whether they stand ``outside`` the group's largest one."""
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("rows"))
    homes = sizes.groupBy(F.col("token").alias("h_token")).agg(
        F.max(F.struct("rows", "component"))["component"].alias("home"), F.count("*").alias("parts")
    )
    homes = homes.where("parts > 1").drop("parts")
    found = rows.join(homes, F.col("token") == F.col("h_token")).withColumn("outside", F.col("component") != F.col("home"))
    return stored(found.drop("h_token", "home"), name)


def _joined(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Unsettled ``rows`` again after ``links`` (a, b) have made larger components of theirs."""
    of = rows.select(F.col("doc_id").alias("o_id"), F.col("component").alias("of")).distinct()
    met = links.join(of, F.col("a") == F.col("o_id")).select("b", F.col("of").alias("from"))
    met = met.join(of, F.col("b") == F.col("o_id")).select(F.col("from").alias("a"), F.col("of").alias("b"))
    larger = components(met).select(F.col("id").alias("l_id"), F.col("component").alias("label"))
    before = rows.drop("outside").withColumnRenamed("component", "before")
    return _unsettled(_labelled(before, larger, "before").drop("before"), name)


def links(docs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that connect every two documents which links of all pairs connect."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = sets.where("doc_id is not null").select("doc_id", "n", F.posexplode("prefix").alias("place", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("doc_id", "n", "place")).alias("center"))
    shared = shared.where("members > 1").withColumnRenamed("token", "s_token")
    cells = stored(tokens.join(shared, F.col("token") == F.col("s_token")).drop("s_token"), "cells")

    fits = _reachable(F.col("n"), F.col("place"), F.col("center.n"), F.col("center.place"), join)
    star = cells.where((F.col("doc_id") != F.col("center.doc_id")) & fits)
    star = stored(star.select(F.col("center.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    found, tried = verified(star, sets, docs, join), star

    def labels() -> DataFrame:
        table = stored(components(found).select(F.col("id").alias("l_id"), F.col("component").alias("label")), "labels")
        return _marked(table, table.count(), join)

    now = labels()
    columns = ["token", "doc_id", "n", "place", F.col("center.doc_id").alias("center")]
    large = cells.where(F.col("members") > join.small).select(*columns, (F.col("doc_id") == F.col("center.doc_id")).alias("met"))
    large = _unsettled(_labelled(large, now, "doc_id"), "unsettled")
    # Rows that have met all others of their group need not look again: a group's center, then its scouts.
    looks = F.col("outside") & ~F.col("met")
    scout = looks & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(join.scouts)) == 0)
    large = large.withColumn("apart", scout)
    if large.where("apart").limit(1).count():
        pairs = tile_pairs(large, sets, join, kind).where("a <> b").distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "scouted")
        more = verified(pairs, sets, docs, join)
        found, tried = stored(found.union(more), "found"), stored(tried.union(pairs), "tried")
        large = large.withColumn("met", F.col("met") | F.col("apart")).drop("apart")
        large = _joined(large, more, "unsettled")
        now = labels()
    # In a group of two all is said.
    small = cells.where((F.col("members") > 2) & (F.col("members") <= join.small)).select(*columns)
    small = _unsettled(_labelled(small, now, "doc_id"), "unsettled")
    rest = small_group_pairs(small, join, kind)
    rest = rest.union(tile_pairs(large.withColumn("apart", looks), sets, join, kind)).where("a <> b").distinct()
    # Other pairs are settled.
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    return found.union(verified(rest, sets, docs, join))


def near_copies(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.select("doc_id", "text")
    hot, classes = frequent(docs, join)
    sets = described(docs, join, hot, classes)
    groups = components(links(docs, sets, join)).select(F.col("id").alias("c_id"), "component")
    found = sets.select("doc_id", F.col("n").alias("n_shingles")).join(groups, F.col("doc_id") == F.col("c_id"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id. Where ids repeat or are missing, the id and a digest of
    the text name a document (no id comes last): different texts under one id are documents of their own, equal texts under one id
    are one, and equal texts without an id are copies like any others (without words they link with nothing, and stay)."""
    key, kind = F.col("doc_id"), docs.schema["doc_id"].dataType
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() > 0
    if odd:
        order = F.lpad((key.cast("decimal(38,0)") + F.lit(Decimal(2**63))).cast("string"), 20, "0") if isinstance(kind, T.IntegralType) else key.cast("string")
        digest = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)
        key = F.concat(F.coalesce(F.concat(F.lit("0"), order), F.lit("1")), F.lit(":"), digest)
    found = near_copies(docs.select(key.alias("doc_id"), "text"), join)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("g_id")).distinct(), "gone")
    kept = docs.join(_marked(gone, gone.count(), join), key == F.col("g_id"), "left_anti")
    if not odd:
        return kept
    others = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    place = F.row_number().over(Window.partitionBy(key).orderBy(others))
    has_words = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    single = kept.where(has_words | F.col("doc_id").isNotNull()).withColumn("_place", place).where("_place = 1").drop("_place")
    return single.unionByName(kept.where(~has_words & F.col("doc_id").isNull()))
