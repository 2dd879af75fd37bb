"""The prefix trie against one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def content(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:12]


def brute(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, content(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, len(path)))
    children, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in nodes:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members) - 1) * words
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(path))))
        parent = min(nodes[path[:-1]])[0] if path else None
        found = (min(members)[0], len(path), parent, len(members), children.get(path, 0), leaves[path], saved[path])
        out.append((*found, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    result = trie.prefix_trie(df, **options)
    assert sorted(result.columns) == sorted(NAMES)
    return sorted((tuple(r[n] for n in NAMES) for r in result.collect()), key=repr)


def talk(seed, convs, longest, words=("a", "a b", "c\td  e", "")):
    """Conversations over few different turns, so that many prefixes are shared at every depth."""
    draw, rows = random.Random(seed), []
    trunk = [("user", draw.choice(words) + str(draw.randint(0, 1))) for _ in range(longest)]
    for c in convs:
        same = draw.randint(0, longest)
        for turn in range(draw.randint(0, longest)):
            role, text = trunk[turn] if turn < same else (draw.choice(("user", "system")), draw.choice(words))
            rows.append((c, turn, role, text))
    return rows


@pytest.mark.parametrize("longest, span", [(8, 64), (9, 64), (75, 3)])
def test_against_plain_tries(spark, longest, span):
    rows = talk(longest, range(35, 115), longest)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), span=span) == brute(rows)


def test_large_groups(spark, monkeypatch):
    """A third of all conversations are the same one, a third share the first turns, and one has a third of all turns."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(4)]
    rows += [(c, t, "user", f"same {t}" if t < 3 else f"own {c}") for c in range(300, 600) for t in range(5)]
    rows += [(700, t, "user", f"turn {t}") for t in range(1200)]
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "HEAVY", 1)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (20, None, None, None), (20, 1, "user", "x  y"), (20, 1, "user", "x  y"), (20, 2, "", "z"),
        (21, 0, "user", "only"), (25, 5, "a", "tie"), (25, 5, "b", "tie"), (-7, 0, "user", "below zero"), (-7, 1, "user", None),
        (44, 0, "user", "word " * 50000), (45, 0, "user", "word " * 50000), (60, -1, "é", "\x0b ü \x0c"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("place", "block", "key", "prior", "next", "length", "id", "row", "t0", "h", "depth"):
        df = df.withColumn(name, F.lit("clash"))
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == [] and found(df.where("conv_id is null")) == []
    only = [(1, 0, "user", "one")]
    assert found(spark.createDataFrame(only, SCHEMA)) == brute(only)
