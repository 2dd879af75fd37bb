"""The trie of all prefixes of conversations, by ROLLUP over positional columns of turn ids.

A turn is known by an id made of its role and text, which also holds the number of words. ``WIDTH`` turns of a conversation are a block: a row with a
column for every place. One ``GROUP BY block, prior, ROLLUP (t0, ..., t7)`` gives every prefix of every block, and grouping_id tells
its depth. Longer conversations go on in further blocks, keyed by ``prior``, the key of the node where the block before ended. All
blocks are grouped by the same query: what came before a block is a digest over a hierarchy of ``SPAN`` blocks,
``SPAN`` of such groups, and so on, so that no long conversation is walked turn by turn.

Only nodes with two members or more are rolled up a second time, for the sums over their subtrees: below a node with one member
there is one leaf and nothing is saved. Across blocks these sums go up by doubled distances (``_upwards``).

Places of turns come from ranges of (conversation, turn), so that a conversation with a large part of all rows is spread over many
tasks, and parents with many children are broadcast, which are at most ``HEAVY`` by their count. SHA-256 over the members that
end at a node is one chain of updates; ids are joined to texts of ``CHUNK`` ids in parallel, and the last task only
streams those of one node.

Defined cases: rows without conv_id belong to no conversation and are left out; a null role or text is empty; a null turn comes
first. Rows of a conversation with the same turn are ordered by their content's digest, and repeated rows are turns of their own. An empty
table gives an empty result. Other columns are not looked at. The length of a text is not bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.frames import bounded, map_batches
from tallyweave.session import stored

#: Turns of a block, and blocks (or groups of blocks) that one digest covers.
WIDTH, SPAN = 8, 64
#: Parents whose children are found by a broadcast are at most so many.
HEAVY = 10_000
#: Ids joined to one text.
CHUNK = 4096
#: Bytes of a turn's id and of a node's key.
TURN_BYTES, KEY_BYTES = 16, 16

ROOT = bytes(KEY_BYTES)
_SLOTS = [f"t{i}" for i in range(WIDTH)]
#: The last turn of a prefix and its depth in the block, by grouping_id (the last place counts twice, as ``next`` goes with it);
#: the turn is null for prefixes that reach beyond the end of their row.
_LAST = f"CASE {WIDTH} - greatest(bit_count(grouping_id()) - 1, 0) " + " ".join(f"WHEN {i + 1} THEN {t}" for i, t in enumerate(_SLOTS)) + " END"
_DEPTH = f"{WIDTH} - greatest(bit_count(grouping_id()) - 1, 0)"
_ROLLUP = f"GROUP BY block, prior, ROLLUP ({', '.join(_SLOTS[:-1])}, ({_SLOTS[-1]}, next))"

#: Every prefix of every block, with its members.
NODES = f"""
SELECT block, prior, {', '.join(_SLOTS)}, next, {_DEPTH} AS kept, {_LAST} AS last,
    count(*) AS n_convs, min(conv_id) AS conv_id, max(length) AS longest
FROM {{blocks}} {_ROLLUP}
HAVING {_LAST} IS NOT NULL
"""

#: Sums over the subtree of every prefix as far as its block reaches, and over the whole of a block (kept = 0).
SUBTREES = f"""
SELECT block, prior, {', '.join(_SLOTS)}, next, {_DEPTH} AS kept, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens
FROM {{nodes}} {_ROLLUP}
HAVING {_LAST} IS NOT NULL OR grouping_id() = {2 ** (WIDTH + 1) - 1}
"""


def digest(data: Column, size: int = KEY_BYTES) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 2 * size))


def turn_ids(role: Column, text: Column) -> Column:
    """Digest of role and text, and the number of words of the text in the last four bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(digest(content.cast("binary"), TURN_BYTES - 4), F.unhex(F.lpad(F.hex(words), 8, "0")))


def words_of(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, TURN_BYTES - 3, 4)), 16, 10).cast("bigint")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and (conv_id, place, turn, length) of its turns, places from 0."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", turn_ids(F.col("role"), F.col("text")).alias("id"), F.monotonically_increasing_id().alias("row")
    )
    rows = stored(rows, "turns")
    order = ["conv_id", "turn", "id", "row"]
    ranged = stored(rows.repartitionByRange(*order).select(*order, F.spark_partition_id().alias("range")), "ranges")

    # A conversation has a row here for every range it reaches into.
    counted = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("here"))
    by_conversation = Window.partitionBy("conv_id")
    before = by_conversation.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(
        "conv_id", "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(by_conversation).alias("n")
    )
    firsts = Window.partitionBy("conv_id").orderBy("turn", "id", "row")
    heads = (
        rows.where("conv_id % 20 = 0")
        .withColumn("place", F.row_number().over(firsts))
        .where("place <= 3")
        .groupBy(F.col("conv_id").alias("first_id"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("head"))
    )
    counted = (
        counted.withColumn("first_id", F.expr("conv_id - conv_id % 20"))
        .join(heads, "first_id", "left")
        .withColumn("h", shared_turns(F.col("conv_id")))
        .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h")))
        .withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "range", "before", "h", "head", "length")
    )
    counted = stored(counted, "conversations")
    once = counted.where("before = 0")
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "id", "row")
    own = (
        ranged.withColumn("at", F.row_number().over(inside) - 1)
        .join(counted.select("conv_id", "range", "before", "h", F.size("head").alias("k"), "length"), ["conv_id", "range"])
        .withColumn("at", F.col("at") + F.col("before"))
        .where("at >= h")
        .select("conv_id", (F.col("k") + F.col("at") - F.col("h")).alias("place"), "id", "length")
    )
    taken = once.select("conv_id", F.posexplode("head").alias("place", "id"), "length")
    turns = taken.select("conv_id", F.col("place").cast("bigint").alias("place"), "id", "length").unionByName(own)
    return once.select("conv_id", "length"), turns


def prefix_keys(blocks: DataFrame, most: int, span: int = SPAN) -> DataFrame:
    """(conv_id, place, key) of full blocks (conv_id, place from 0 without gaps, digest): the key stands for all digests up to
    the place. ``most`` is the highest place."""
    groups = blocks.groupBy("conv_id", F.floor(F.col("place") / span).alias("group")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("parts")
    )
    if most >= span - 1:
        full = groups.where(F.size("parts") == span)
        full = full.select("conv_id", F.col("group").alias("place"), digest(F.array_join(F.transform("parts", F.hex), "").cast("binary")).alias("digest"))
        above = stored(prefix_keys(stored(full, "groups"), (most + 1) // span - 1, span), "keys")
        groups = groups.join(above.select("conv_id", F.col("place").alias("group"), F.col("key").alias("whole")), ["conv_id", "group"], "left")
        groups = groups.join(above.select("conv_id", (F.col("place") + 1).alias("group"), F.col("key").alias("start")), ["conv_id", "group"], "left")
    else:
        groups = groups.withColumns({"whole": F.lit(None).cast("binary"), "start": F.lit(None).cast("binary")})
    start = F.hex(F.coalesce("start", F.lit(ROOT)))
    upto = F.concat(start, F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("i") + 1), F.hex), ""))
    return groups.select("*", F.posexplode("parts").alias("i", "part")).select(
        "conv_id",
        (F.col("group") * span + F.col("i")).alias("place"),
        F.when(F.col("i") == span - 1, F.col("whole")).otherwise(digest(upto.cast("binary"))).alias("key"),
    )


def block_rows(turns: DataFrame, longest: int, span: int = SPAN) -> DataFrame:
    """(conv_id, block, prior, t0 ..., next, size, length): ``prior`` is the key of the node before the block, ``next`` that of its
    last node if the block is full."""
    rows = turns.groupBy("conv_id", F.floor(F.col("place") / WIDTH).alias("block"), "length").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids")
    )
    rows = rows.select(
        "conv_id", "block", "length", F.size("ids").alias("size"), *[F.get("ids", F.lit(i)).alias(t) for i, t in enumerate(_SLOTS)]
    )
    whole = F.when(F.col("size") == WIDTH, digest(F.concat(*_SLOTS)))
    first = F.when(F.col("size") == WIDTH, digest(F.concat(F.hex(F.lit(ROOT)), F.hex(whole)).cast("binary")))
    rows = stored(rows, "blocks")
    done = rows.where("block = 0").select("*", F.lit(ROOT).alias("prior"), first.alias("next"))
    if longest <= WIDTH:
        return done
    full = rows.where(F.col("size") == WIDTH).where(F.col("length") > WIDTH)
    full = full.select("conv_id", F.col("block").alias("place"), whole.alias("digest"))
    keys = stored(prefix_keys(stored(full, "digests"), longest // WIDTH - 1, span), "keys")
    later = (
        rows.where("block > 0")
        .join(keys.select("conv_id", (F.col("place") + 1).alias("block"), F.col("key").alias("prior")), ["conv_id", "block"])
        .join(keys.select("conv_id", F.col("place").alias("block"), F.col("key").alias("next")), ["conv_id", "block"], "left")
    )
    return done.unionByName(later)


def _key() -> Column:
    """Key of the node that a row of slots (null from some place on) leads to."""
    return F.coalesce("next", digest(F.concat("prior", *[F.coalesce(t, F.lit(b"")) for t in _SLOTS])))


def _parent_key() -> Column:
    before = F.concat("prior", *[F.coalesce(t, F.lit(b"")) for t in _SLOTS])
    shorter = F.expr(f"size({_KEPT}) - 1")
    return F.when(shorter == 0, F.col("prior")).otherwise(digest(F.substring(before, F.lit(1), KEY_BYTES + TURN_BYTES * shorter)))


_KEPT = f"filter(array({', '.join(_SLOTS)}), x -> x IS NOT NULL)"


def _upwards(shared: DataFrame, deepest: int) -> DataFrame:
    """(key, n_leaves, saved_tokens) of nodes at the ends of blocks: sums over all blocks below them. Round by round a node adds
    what the nodes below at 1, 2, 4, ... blocks have added up."""
    inside = shared.where("block > 0").groupBy("prior").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = shared.where(f"kept = {WIDTH} AND block > 0").select(F.col("key").alias("prior"), F.col("prior").alias("up"))
    sums = stored(inside.join(above, "prior", "left").withColumnRenamed("prior", "key"), "sums")
    distance = 1
    while distance < deepest:
        rows = sums.count()
        below = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        further = bounded(sums.select(F.col("key").alias("up"), F.col("up").alias("up_next")), rows)
        sums = (
            sums.join(below, "key", "left")
            .join(further, "up", "left")
            .select(
                "key",
                (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("up_next").alias("up"),
            )
        )
        sums = stored(sums, "sums")
        distance *= 2
    return sums.select("key", F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) of one range, sorted: the digest of each node that lies within the range, and for the first and the
    last node, which others may share, texts of joined ids."""
    names, types = ["key", "first_id", "ids", "sha256"], [pa.binary(), pa.int64(), pa.string(), pa.string()]
    out: list[tuple] = []
    key, ids, edge, seen = None, [], True, False

    def close(last: bool) -> None:
        if ids and (edge or last):
            out.append((key, ids[0], ",".join(map(str, ids)), None))
        elif ids:
            out.append((key, ids[0], None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
        ids.clear()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for new, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if new != key:
                close(False)
                edge, seen, key = not seen, True, new
            elif len(ids) >= CHUNK:
                edge = True
                close(True)
            ids.append(conv_id)
            if len(out) >= 1000:
                yield flushed()
    close(True)
    if out:
        yield flushed()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest over the texts of each node, which come one after the other."""
    key, chain = None, None
    for batch in batches:
        keys, digests = [], []
        for new, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if new != key:
                if chain:
                    keys.append(key)
                    digests.append(chain.hexdigest())
                key, chain = new, hashlib.sha256(text.encode())
            else:
                chain.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if chain:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([chain.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) over the comma-joined conv_ids, ascending, of every key of ``ends`` (key, conv_id)."""
    ends = stored(ends.select("key", F.col("conv_id").cast("bigint").alias("conv_id")), "ends")
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = stored(map_batches(ranged, _pieces, "key binary, first_id bigint, ids string, sha256 string"), "pieces")
    parts = found.where("ids IS NOT NULL").repartition("key").sortWithinPartitions("key", "first_id")
    chained = map_batches(parts, _chained, "key binary, ends_sha256 string")
    return found.where("sha256 IS NOT NULL").select("key", F.col("sha256").alias("ends_sha256")).unionByName(chained)


def with_parents(nodes: DataFrame, parents: DataFrame, total: int) -> DataFrame:
    """Add ``parent_conv_id``; a node whose parent has no row in ``parents`` has its parent's only member for its own."""
    least = max(1000, total // HEAVY)  # so that no more than HEAVY parents have as many children
    parents = parents.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = parents.where(F.col("n_children") >= least).drop("n_children")
    light = parents.where(F.col("n_children") < least).drop("n_children")
    tried = nodes.join(F.broadcast(heavy), "parent_key", "left")
    found = tried.where("parent_conv_id IS NOT NULL")
    rest = tried.where("parent_conv_id IS NULL").drop("parent_conv_id").join(light, "parent_key", "left")
    return found.unionByName(rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id")))


def prefix_trie(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """A row for every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations)
    n_convs, least_id, longest = convs.agg(F.count("*"), F.min("conv_id"), F.coalesce(F.max("length"), F.lit(0))).first()
    blocks = stored(block_rows(turns, longest, span), "block-rows")

    nodes = spark.sql(NODES, blocks=blocks).select(
        "block", "prior", *_SLOTS, "next", "kept", "n_convs", "conv_id", "longest",
        (WIDTH * F.col("block") + F.col("kept")).alias("depth"),
        words_of(F.col("last")).alias("words"),
        _key().alias("key"),
        _parent_key().alias("parent_key"),
    )
    nodes = stored(nodes, "nodes")
    total = nodes.count()
    children = nodes.groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("bigint")).alias("singles")
    )
    root = spark.range(1 if n_convs else 0).select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(least_id).cast("bigint").alias("conv_id"),
        F.lit(0).cast("bigint").alias("depth"), F.lit(n_convs).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("words"),
        F.lit(0).cast("bigint").alias("block"), F.lit(ROOT).alias("prior"), F.lit(0).cast("int").alias("kept"),
        F.lit(None).cast("binary").alias("next"), *[F.lit(None).cast("binary").alias(t) for t in _SLOTS],
    )
    shared = nodes.where("n_convs > 1").drop("longest").unionByName(root).join(children, "key", "left")
    shared = shared.withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)),
            "leaves": F.coalesce("singles", F.lit(0)) + F.col("n_children").isNull().cast("bigint"),
            "saved": (F.col("n_convs") - 1) * F.col("words"),
        }
    ).drop("singles")
    shared = stored(shared, "shared")
    deepest = shared.agg(F.max("block")).first()[0] or 0
    if deepest:
        shared = shared.join(_upwards(shared, deepest), "key", "left")
    else:
        shared = shared.withColumns({"below_leaves": F.lit(0), "below_saved": F.lit(0)})
    summed = shared.withColumns(
        {n: F.col(n) + F.when(F.col("kept") == WIDTH, F.coalesce(f"below_{n}", F.lit(0))).otherwise(0) for n in ("leaves", "saved")}
    )
    sums = spark.sql(SUBTREES, nodes=summed).where("kept > 0 OR block = 0")
    sums = sums.select(F.when(F.col("kept") == 0, F.lit(ROOT)).otherwise(_key()).alias("key"), "n_leaves", "saved_tokens")

    columns = ["key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    alone = nodes.where("n_convs = 1").withColumns(
        {"n_children": (F.col("longest") > F.col("depth")).cast("bigint"), "n_leaves": F.lit(1).cast("bigint"), "saved_tokens": F.lit(0).cast("bigint")}
    )
    every = shared.join(sums, "key").select(*columns).unionByName(alone.select(*columns))
    ending = blocks.where(WIDTH * F.col("block") + F.col("size") == F.col("length")).select(_key().alias("key"), "conv_id")
    ending = ending.unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    every = every.join(end_digests(ending), "key", "left")
    placed = with_parents(every.where("parent_key IS NOT NULL"), shared.where("n_children > 0"), total)
    placed = placed.unionByName(every.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    return placed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
