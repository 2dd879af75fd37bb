"""The registered queries restated as plain SQL over the same tables."""

from __future__ import annotations

import xxhash

KEY = "src_ip, dst_ip, src_port, dst_port, proto"
KEY_TEXT = f"concat_ws('|', {KEY})"
U32 = "4294967295"

EV = """ev AS (
  SELECT event_id AS packet_id, ts, CAST(event_id % 4 AS INTEGER) AS cpu,
         CAST(3232235520 + user_id AS BIGINT) AS src_ip,
         CAST(3232301056 + length(event_type) AS BIGINT) AS dst_ip,
         CAST(1024 + user_id % 1000 AS INTEGER) AS src_port, CAST(5678 AS INTEGER) AS dst_port,
         CAST(CASE WHEN event_type = 'error' THEN 1
                   WHEN event_type IN ('purchase', 'signup') THEN 6 ELSE 17 END AS INTEGER) AS proto,
         CAST(64 + CAST(floor(value) AS INTEGER) % 1400 AS INTEGER) AS wire_len
  FROM events),
flows AS (SELECT * FROM ev WHERE proto IN (6, 17))"""

LI = """li AS (
  SELECT l_shipdate AS ts, CAST(l_orderkey % 4 AS INTEGER) AS cpu,
         CAST(167772160 + l_suppkey AS BIGINT) AS src_ip, CAST(184549376 + l_partkey AS BIGINT) AS dst_ip,
         CAST(1024 + l_linenumber AS INTEGER) AS src_port,
         CAST(CASE l_returnflag WHEN 'A' THEN 443 WHEN 'N' THEN 80 ELSE 53 END AS INTEGER) AS dst_port,
         CAST(CASE WHEN l_linestatus = 'F' THEN 6 ELSE 17 END AS INTEGER) AS proto,
         CAST(64 + CAST(l_quantity AS INTEGER) * 28 AS INTEGER) AS wire_len
  FROM lineitem),
flows AS (SELECT * FROM li)"""

ORACLES: dict[str, str] = {}


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def hex_at(text: str, first: int, digits: int) -> str:
    return f"CAST(('0x' || substr({text}, {first}, {digits})) AS BIGINT)"


def md5_word(text: str, i: int = 0) -> str:
    return hex_at(f"md5({text})", 8 * i + 1, 8)


VERDICT = "CASE WHEN proto IN (6, 17) THEN 'COUNTED' ELSE 'ERROR_DROP' END"


# Flow rows ---------------------------------------------------------------------

ORACLES["flow_projection"] = with_(EV) + f"SELECT *, {VERDICT} AS verdict FROM ev"
ORACLES["flow_projection_lineitem"] = with_(LI) + f"SELECT *, {VERDICT} AS verdict FROM li"
ORACLES["verdicts"] = with_(EV) + f"""
SELECT {VERDICT} AS verdict, CASE WHEN proto IN (6, 17) THEN 'REDIRECT' ELSE 'DROP' END AS action,
       count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes
FROM ev GROUP BY ALL"""


def dotted(ip: str) -> str:
    return " || '.' || ".join(f"CAST(({ip} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0))


ORACLES["ip_text_roundtrip"] = with_(EV) + f"""
SELECT packet_id, {dotted('src_ip')} AS src_text, {dotted('dst_ip')} AS dst_text, src_ip, dst_ip FROM ev"""
ORACLES["key_pack13"] = with_(EV) + """
SELECT packet_id, format('{:08x}{:08x}{:04x}{:04x}{:02x}', src_ip, dst_ip, src_port, dst_port, proto) AS key_hex
FROM ev"""

ORACLES["frame_roundtrip"] = with_(EV, """shaped AS (
  SELECT *, packet_id % 4 AS tags, packet_id % 8 AS kind, CASE WHEN proto = 6 THEN 20 ELSE 8 END AS payload,
         packet_id % 5 < 3 AS ipv4
  FROM ev)""", """sized AS (
  SELECT *, CASE kind WHEN 4 THEN 33 + 4 * tags + payload WHEN 5 THEN 33 + 4 * tags
                      WHEN 6 THEN 13 + 4 * tags WHEN 7 THEN 10 ELSE 34 + 4 * tags + payload END AS size
  FROM shaped)""", """seen AS (
  SELECT *, CASE WHEN tags >= 1 AND size >= 14 THEN CASE WHEN tags >= 2 AND size >= 18 THEN 2 ELSE 1 END ELSE 0 END AS depth
  FROM sized)""", """judged AS (
  SELECT *, CASE WHEN size < 14 + 4 * depth THEN 'ERROR_DROP'
                 WHEN tags = 3 OR NOT ipv4 THEN 'PASS'
                 WHEN size < 34 + 4 * depth THEN 'ERROR_DROP'
                 WHEN proto NOT IN (6, 17) THEN 'ERROR_DROP'
                 WHEN size < 34 + 4 * depth + payload THEN 'ERROR_DROP'
                 ELSE 'COUNTED' END AS verdict
  FROM seen)""") + """
SELECT packet_id, CAST(depth AS INTEGER) AS vlan_depth, verdict,
       CASE WHEN verdict = 'COUNTED' THEN src_ip END AS src_ip,
       CASE WHEN verdict = 'COUNTED' THEN dst_ip END AS dst_ip,
       CASE WHEN verdict = 'COUNTED' THEN src_port END AS src_port,
       CASE WHEN verdict = 'COUNTED' THEN dst_port END AS dst_port,
       CASE WHEN verdict = 'COUNTED' THEN proto END AS proto,
       CAST(size AS INTEGER) AS wire_len
FROM judged"""

ORACLES["synthetic_packets"] = """
SELECT event_id AS packet_id, CAST(3232235521 AS BIGINT) AS src_ip,
       CAST(3232235777 + event_id % 254 AS BIGINT) AS dst_ip, CAST(1234 AS INTEGER) AS src_port,
       CAST(5678 + event_id % 4423 AS INTEGER) AS dst_port, CAST(17 AS INTEGER) AS proto,
       CAST(64 AS INTEGER) AS wire_len, 'COUNTED' AS verdict
FROM events"""


# Hashes --------------------------------------------------------------------------

M64 = "18446744073709551616"


def _mul64(a: str, constant: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * {constant}) % {M64} AS UBIGINT)"


def _add64(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {M64} AS UBIGINT)"


def _rotl64(a: str, r: int) -> str:
    high = f"CAST((CAST({a} AS UHUGEINT) << {r}) % {M64} AS UBIGINT)"
    return f"({high} | ({a} >> {64 - r}))"


def _mul32(a: str, constant: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * {constant}) % 4294967296 AS UBIGINT)"


def _add32(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % 4294967296)"


def _sub32(a: str, b: str) -> str:
    return f"(({a} + 4294967296 - {b}) % 4294967296)"


def _rotl32(a: str, r: int) -> str:
    return f"((({a} << {r}) | ({a} >> {32 - r})) % 4294967296)"


def _signed(h: str) -> str:
    return f"CAST(CASE WHEN {h} >= 9223372036854775808 THEN CAST({h} AS HUGEINT) - {M64} ELSE {h} END AS BIGINT)"


def _swap32(v: str) -> str:
    v = f"CAST({v} AS UBIGINT)"
    return f"((({v} & 255) << 24) | ((({v} >> 8) & 255) << 16) | ((({v} >> 16) & 255) << 8) | ({v} >> 24))"


def _swap16(v: str) -> str:
    v = f"CAST({v} AS UBIGINT)"
    return f"((({v} & 255) << 8) | ({v} >> 8))"


#: The packed key as little-endian words: w0, w1, w2 of 32 bits and the last byte b.
WORDS = f"""words AS (
  SELECT packet_id, {_swap32('src_ip')} AS w0, {_swap32('dst_ip')} AS w1,
         ({_swap16('src_port')} | ({_swap16('dst_port')} << 16)) AS w2, CAST(proto AS UBIGINT) AS b
  FROM ev)"""


class Steps:
    """SQL built as a chain of CTEs, each of which redefines one column."""

    def __init__(self, *start: str, source: str, columns: tuple[str, ...]) -> None:
        self.parts = list(start)
        self.source = source
        self.columns = list(columns)
        self.prefix = ""

    def set(self, name: str, expression: str) -> None:
        step = f"{self.prefix}s{len(self.parts)}"
        kept = [c for c in self.columns if c != name]
        self.parts.append(f"{step} AS MATERIALIZED (SELECT {', '.join(kept)}, {expression} AS {name} FROM {self.source})")
        self.columns = [*kept, name]
        self.source = step

    def select(self, expression: str) -> str:
        return with_(*self.parts) + f"SELECT packet_id, {expression} AS h FROM {self.source}"


def _key_steps() -> Steps:
    return Steps(EV, WORDS, source="words", columns=("packet_id", "w0", "w1", "w2", "b"))


def _fasthash(seed: int, final: str) -> str:
    # Fixed values of the published algorithm.
    m, k = 0x880355F21E6D1965, 0x2127599BF4325C37
    q = _key_steps()

    def mix(name: str) -> None:
        q.set(name, f"xor({name}, {name} >> 23)")
        q.set(name, _mul64(name, k))
        q.set(name, f"xor({name}, {name} >> 47)")

    q.set("h", f"CAST({seed ^ (13 * m % (1 << 64))} AS UBIGINT)")
    q.set("v0", "(w0 | (w1 << 32))")
    q.set("v1", "(w2 | (b << 32))")
    for v in ("v0", "v1"):
        mix(v)
        q.set("h", _mul64(f"xor(h, {v})", m))
    mix("h")
    return q.select(final)


ORACLES["hash_fasthash64"] = _fasthash(0x2D31E867, _signed("h"))
FASTHASH32 = f"CAST((CAST(h AS UHUGEINT) + {M64} - (h >> 32)) % 4294967296 AS BIGINT)"
ORACLES["hash_fasthash32"] = _fasthash(0xDEADBEEF, FASTHASH32)


def _xxhash32(seed: int) -> str:
    # The primes of xxHash.
    p1, p2, p3, p4, p5 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1
    q = _key_steps()
    q.set("h", f"CAST({(seed + p5 + 13) % (1 << 32)} AS UBIGINT)")
    for w in ("w0", "w1", "w2"):
        q.set("h", _add32("h", _mul32(w, p3)))
        q.set("h", _mul32(_rotl32("h", 17), p4))
    q.set("h", _add32("h", _mul32("b", p5)))
    q.set("h", _mul32(_rotl32("h", 11), p1))
    q.set("h", _mul32("xor(h, h >> 15)", p2))
    q.set("h", _mul32("xor(h, h >> 13)", p3))
    return q.select("CAST(xor(h, h >> 16) AS BIGINT)")


def _xxhash64(seed: int) -> str:
    # The primes of xxHash.
    p1, p2, p3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    p4, p5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    q = _key_steps()
    q.set("h", f"CAST({(seed + p5 + 13) % (1 << 64)} AS UBIGINT)")
    q.set("v", _mul64("(w0 | (w1 << 32))", p2))
    q.set("v", _mul64(_rotl64("v", 31), p1))
    q.set("h", "xor(h, v)")
    q.set("h", _add64(_mul64(_rotl64("h", 27), p1), str(p4)))
    q.set("h", f"xor(h, {_mul64('w2', p1)})")
    q.set("h", _add64(_mul64(_rotl64("h", 23), p2), str(p3)))
    q.set("h", f"xor(h, {_mul64('b', p5)})")
    q.set("h", _mul64(_rotl64("h", 11), p1))
    q.set("h", _mul64("xor(h, h >> 33)", p2))
    q.set("h", _mul64("xor(h, h >> 29)", p3))
    q.set("h", "xor(h, h >> 32)")
    return q.select(_signed("h"))


ORACLES["hash_xxhash32"] = _xxhash32(0x2D31E867)
ORACLES["hash_xxhash64"] = _xxhash64(0x2D31E867)
ORACLES["hash_xxhash64_native"] = _xxhash64(42)


def _murmur3(seed: int) -> str:
    # Fixed values of the published algorithm.
    c1, c2 = 0xCC9E2D51, 0x1B873593
    q = _key_steps()
    q.set("h", f"CAST({seed} AS UBIGINT)")
    for w in ("w0", "w1", "w2", "b"):
        q.set(w, _mul32(w, c1))
        q.set(w, _mul32(_rotl32(w, 15), c2))
        q.set("h", f"xor(h, {w})")
        if w != "b":
            q.set("h", _add32(_mul32(_rotl32("h", 13), 5), str(0xE6546B64)))
    q.set("h", "xor(h, 13)")
    q.set("h", _mul32("xor(h, h >> 16)", 0x85EBCA6B))
    q.set("h", _mul32("xor(h, h >> 13)", 0xC2B2AE35))
    return q.select("CAST(xor(h, h >> 16) AS BIGINT)")


ORACLES["hash_murmur3"] = _murmur3(0x12344321)


def _lookup3_final(q: Steps) -> None:
    # The last rounds of lookup3.
    for x, y, r in (("c", "b", 14), ("a", "c", 11), ("d", "a", 25), ("c", "d", 16), ("a", "c", 4), ("d", "a", 14), ("c", "d", 24)):
        x, y = x.replace("b", "d"), y.replace("b", "d")
        q.set(x, _sub32(f"xor({x}, {y})", _rotl32(y, r)))


def _jhash(seed: int) -> str:
    q = _key_steps()
    start = (0xDEADBEEF + 13 + seed) % (1 << 32)
    for name, w in (("a", "w0"), ("d", "w1"), ("c", "w2")):
        q.set(name, _add32(w, str(start)))
    # The rounds between blocks of lookup3.
    for x, y, z, r in (("a", "c", "d", 4), ("d", "a", "c", 6), ("c", "d", "a", 8), ("a", "c", "d", 16), ("d", "a", "c", 19), ("c", "d", "a", 4)):
        q.set(x, f"xor({_sub32(x, y)}, {_rotl32(y, r)})")
        q.set(y, _add32(y, z))
    q.set("a", _add32("a", "b"))
    _lookup3_final(q)
    return q.select("CAST(c AS BIGINT)")


ORACLES["hash_jhash"] = _jhash(0x12344321)


def _jhash_words(seed: int) -> str:
    q = Steps(
        EV,
        "base AS (SELECT packet_id, CAST(src_ip AS UBIGINT) AS w0, CAST(dst_ip AS UBIGINT) AS w1,"
        " ((CAST(src_port AS UBIGINT) << 16) | CAST(dst_port AS UBIGINT)) AS w2 FROM ev)",
        source="base",
        columns=("packet_id", "w0", "w1", "w2"),
    )
    for n in (1, 2, 3):
        start = str((0xDEADBEEF + 4 * n + seed) % (1 << 32))
        for i, name in enumerate(("a", "d", "c")):
            q.set(name, _add32(f"w{i}", start) if i < n else f"CAST({start} AS UBIGINT)")
        _lookup3_final(q)
        q.set(f"h{n}", "CAST(c AS BIGINT)")
    return with_(*q.parts) + f"SELECT packet_id, h1, h2, h3 FROM {q.source}"


ORACLES["hash_jhash_words"] = _jhash_words(7)


def _siphash(secret: bytes) -> str:
    k0, k1 = (int.from_bytes(secret[i : i + 8], "little") for i in (0, 8))
    q = _key_steps()
    # The initial state of SipHash.
    for name, value in (
        ("x0", k0 ^ 0x736F6D6570736575), ("x1", k1 ^ 0x646F72616E646F6D),
        ("x2", k0 ^ 0x6C7967656E657261), ("x3", k1 ^ 0x7465646279746573),
    ):
        q.set(name, f"CAST({value} AS UBIGINT)")

    def half(a, b, c, d, s, t):
        q.set(a, _add64(a, b))
        q.set(c, _add64(c, d))
        q.set(b, f"xor({_rotl64(b, s)}, {a})")
        q.set(d, f"xor({_rotl64(d, t)}, {c})")
        q.set(a, _rotl64(a, 32))

    def rounds(n):
        for _ in range(n):
            half("x0", "x1", "x2", "x3", 13, 16)
            half("x2", "x1", "x0", "x3", 17, 21)

    for word in ("(w0 | (w1 << 32))", f"(w2 | (b << 32) | CAST({13 << 56} AS UBIGINT))"):
        q.set("x3", f"xor(x3, {word})")
        rounds(2)
        q.set("x0", f"xor(x0, {word})")
    q.set("x2", "xor(x2, 255)")
    rounds(4)
    q.set("h", "xor(xor(x0, x1), xor(x2, x3))")
    return q.select(_signed("h"))


ORACLES["hash_siphash"] = _siphash(b"deadbeeflonglong")


def sign_of(lane: str, bit: int = 15) -> str:
    return f"CAST(CASE WHEN ({lane} & {1 << bit}) <> 0 THEN 1 ELSE -1 END AS BIGINT)"


DIGEST_LANES = [hex_at("digest", 4 * i + 1, 4) for i in range(4)]

ORACLES["hash_lanes_md5"] = with_(EV, f"hashed AS (SELECT packet_id, md5({KEY_TEXT}) AS digest FROM ev)") + (
    "SELECT packet_id, "
    + ", ".join(f"{l} & 511 AS col{i}, {sign_of(l)} AS sign{i}" for i, l in enumerate(DIGEST_LANES))
    + " FROM hashed"
)


def _xor_fold(seeds: tuple[int, ...]) -> str:
    folded = "CAST(0 AS BIGINT)"
    for s in seeds:
        folded = f"xor({folded}, {md5_word(f'''{s} || '|' || {KEY_TEXT}''')})"
    return with_(EV) + f"SELECT packet_id, {folded} AS h FROM ev"


# Five seeds.
ORACLES["hash_xor_fold"] = _xor_fold((0x12344321, 0x22344323, 0x92344139, 0x78234321, 0x6A5D1F0E))


# Bits ----------------------------------------------------------------------------

WORD = f"""base AS (
  SELECT event_id AS packet_id, {md5_word("CAST(event_id AS VARCHAR)")} AS w, CAST(event_id % 33 AS INTEGER) AS s
  FROM events)""" + f""", words AS (
  SELECT packet_id, w, CAST((CAST(w AS HUGEINT) << s) & {U32} AS BIGINT) AS low, w | xor(CAST({U32} AS BIGINT), {U32} >> s) AS high FROM base)"""

ORACLES["bits_trailing_zeros"] = with_(WORD) + """
SELECT packet_id, low, CAST(CASE WHEN low = 0 THEN 0
  ELSE (SELECT min(i) FROM range(32) t(i) WHERE (low >> CAST(i AS BIGINT)) & 1 = 1) END AS INTEGER) AS zeros
FROM words"""
ORACLES["bits_leading_ones"] = with_(WORD) + """
SELECT packet_id, high, CAST(coalesce(
  (SELECT min(i) FROM range(32) t(i) WHERE (high >> CAST(31 - i AS BIGINT)) & 1 = 0), 32) AS INTEGER) AS ones
FROM words"""
ORACLES["bits_array"] = with_(WORD) + f"""
SELECT packet_id, {" || ".join(f"CAST((w >> {i}) & 1 AS VARCHAR)" for i in range(31, -1, -1))} AS msb_first,
       {" || ".join(f"CAST(1 - ((w >> {i}) & 1) AS VARCHAR)" for i in range(32))} AS clear_lsb_first,
       CAST((w >> 5) & 1 AS INTEGER) AS bit5
FROM words"""
ORACLES["floor_mean"] = with_(EV) + """
SELECT packet_id, CAST(floor((src_port - 1500 + wire_len - 300) / 2.0) AS INTEGER) AS mean FROM ev"""


# Cells and estimates ---------------------------------------------------------------

# The primes of xxHash.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _chain(q: Steps, column: str, wide: bool) -> None:
    """Fold one integer column into ``h`` as Spark's xxhash64 does."""
    q.set("h", _add64("h", str(P5 + (8 if wide else 4))))
    if wide:
        q.set("v", _mul64(column, P2))
        q.set("v", _mul64(_rotl64("v", 31), P1))
        q.set("h", "xor(h, v)")
        q.set("h", _add64(_mul64(_rotl64("h", 27), P1), str(P4)))
    else:
        q.set("h", f"xor(h, {_mul64(column, P1)})")
        q.set("h", _add64(_mul64(_rotl64("h", 23), P2), str(P3)))
    q.set("h", _mul64("xor(h, h >> 33)", P2))
    q.set("h", _mul64("xor(h, h >> 29)", P3))
    q.set("h", "xor(h, h >> 32)")


def _constant(value: int, seed: int, wide: bool) -> int:
    """The same for a literal, so that the SQL starts from a number."""
    m = (1 << 64) - 1

    def rotl(x: int, r: int) -> int:
        return ((x << r) | (x >> (64 - r))) & m

    h = (seed + P5 + (8 if wide else 4)) & m
    if wide:
        h = rotl(h ^ (rotl(value * P2 & m, 31) * P1 & m), 27) * P1 + P4 & m
    else:
        h = rotl(h ^ (value * P1 & m), 23) * P2 + P3 & m
    h = (h ^ (h >> 33)) * P2 & m
    h = (h ^ (h >> 29)) * P3 & m
    return h ^ (h >> 32)


def _text(text: str) -> int:
    """Hash of a leading text literal."""
    return xxhash.xxh64_intdigest(text.encode(), 42)


def _xx_columns(prefix: str, source: str, columns: str, start: dict[str, int], wide: tuple[bool, ...]) -> str:
    """CTEs ending in ``prefix``: distinct ``columns`` with one chained hash per start value."""
    names = [c.strip() for c in columns.split(",")]
    q = Steps(f"{prefix}0 AS (SELECT DISTINCT {columns} FROM {source})", source=f"{prefix}0", columns=tuple(names))
    q.prefix = prefix
    for name, seed in start.items():
        q.set("h", f"CAST({seed} AS UBIGINT)")
        for column, is_wide in zip(names, wide):
            _chain(q, column, is_wide)
        q.set(name, "h")
    return ",\n".join(q.parts) + f",\n{prefix} AS (SELECT * FROM {q.source})"


KEY_WIDE = (True, True, False, False, False)


def lanes(source: str = "flows", family: str = "xx") -> str:
    """CTE ``lanes``: 16-bit lanes l0..l3 and layer hash lh of every key of ``source``."""
    if family == "xx":
        start = {"hk": _constant(0x2D31E867, 42, False), "hl": _constant(0xDEADBEEF, 42, True)}
        cut = ", ".join(f"CAST((hk >> {16 * i}) & 65535 AS BIGINT) AS l{i}" for i in range(4))
        return _xx_columns("kh", source, KEY, start, KEY_WIDE) + f""",
lanes AS (SELECT {KEY}, {cut}, CAST(hl & {U32} AS BIGINT) AS lh FROM kh)"""
    if family == "md5":
        digest = f"md5({KEY_TEXT})"
        cut = ", ".join(f"{hex_at(digest, 4 * i + 1, 4)} AS l{i}" for i in range(4))
        layer = hex_at(digest, 17, 8)
    else:
        # One seed per row.
        seeds = (0x2D31E867, 0x6AD611C4, 0x00000000, 0xFFFFFFFF)
        cut = ", ".join(f"{md5_word(f"{s} || '|' || {KEY_TEXT}")} AS l{i}" for i, s in enumerate(seeds))
        layer = "0"
    return f"lanes AS (SELECT {KEY}, {cut}, {layer} AS lh FROM (SELECT DISTINCT {KEY} FROM {source}))"


def updates(source: str = "flows", weight: str = "1", family: str = "xx", keys: str | None = None) -> str:
    """CTE ``upd``: one row per (input row, summary row) with column, sign and weight."""
    bit = 31 if family == "md5_rows" else 15
    selects = [
        f"SELECT {source}.*, {i} AS r, l{i} & 511 AS col, {sign_of(f'l{i}', bit)} AS sgn, {weight} AS w"
        f" FROM {source} JOIN lanes USING ({KEY})"
        for i in range(4)
    ]
    return lanes(keys or source, family) + ",\nupd AS (" + " UNION ALL ".join(selects) + ")"


CM_CELLS = "cells AS (SELECT r, col, sum(w) AS v FROM upd GROUP BY r, col)"
CS_CELLS = "cells AS (SELECT r, col, sum(w * sgn) AS v FROM upd GROUP BY r, col)"
CELL_ROWS = """SELECT CAST(0 AS INTEGER) AS layer, CAST(r AS INTEGER) AS "row", CAST(col AS INTEGER) AS col,
CAST(v AS BIGINT) AS value FROM cells"""

for name, flows, signed, options in (
    ("cm_cells", EV, False, {}),
    ("cm_cells_md5", EV, False, {"family": "md5"}),
    ("cm_cells_lineitem", LI, False, {}),
    ("cs_cells", EV, True, {}),
    ("cs_cells_lineitem", LI, True, {}),
    ("cs_cells_per_row_hash", EV, True, {"family": "md5_rows"}),
    ("cs_cells_bytes", EV, True, {"weight": "wire_len"}),
    ("sketch_merge", EV, True, {}),
    ("sketch_saved", EV, False, {}),
    ("stream_cells", EV, False, {}),
):
    ORACLES[name] = with_(flows, updates(**options), CS_CELLS if signed else CM_CELLS) + CELL_ROWS

ORACLES["sketch_dense_to_long"] = ORACLES["cs_cells"] + " WHERE v <> 0"


def _fasthash_cells() -> str:
    hashed = ORACLES["hash_fasthash64"]
    lane = "((h >> (16 * r)) & 65535)"
    return f"""WITH hashed AS ({hashed}), upd AS (
  SELECT r, {lane} & 511 AS col, CASE WHEN {lane} & 32768 <> 0 THEN 1 ELSE -1 END AS sgn
  FROM hashed JOIN events ON event_id = packet_id AND event_type <> 'error', range(4) t(r)),
cells AS (SELECT r, col, sum(sgn) AS v FROM upd GROUP BY r, col)
{CELL_ROWS}"""


ORACLES["cs_cells_fasthash"] = _fasthash_cells()


def _byte_hash_cells(hashes: list[str]) -> str:
    """Cells of 16-bit lanes cut from one 64-bit hash, or from two of 32 bits."""
    per = 4 // len(hashes)
    lanes_ = [f"(h{i // per} >> {16 * (i % per)}) & 65535" for i in range(4)]
    rows = " UNION ALL ".join(f"SELECT packet_id, {i} AS r, {l} AS l FROM hashed" for i, l in enumerate(lanes_))
    tables = " JOIN ".join(f"(SELECT packet_id, h AS h{i} FROM ({sql})) t{i}" for i, sql in enumerate(hashes))
    on = " USING (packet_id)" if len(hashes) > 1 else ""
    return f"""WITH hashed AS (SELECT * FROM {tables}{on}), rows_ AS ({rows}), upd AS (
  SELECT r, l & 511 AS col, {sign_of("l")} AS sgn FROM rows_ JOIN events ON event_id = packet_id AND event_type <> 'error'),
cells AS (SELECT r, col, sum(sgn) AS v FROM upd GROUP BY r, col)
{CELL_ROWS}"""


ORACLES["cs_cells_jhash"] = _byte_hash_cells([_jhash(0x2D31E867), _jhash(0x6AD611C4)])
ORACLES["cs_cells_murmur3"] = _byte_hash_cells([_murmur3(0x2D31E867), _murmur3(0x6AD611C4)])
ORACLES["cs_cells_siphash"] = _byte_hash_cells([_siphash((0x2D31E867).to_bytes(8, "little") * 2)])


def _row_hash_cells(hashes: list[str]) -> str:
    """Cells of one 32-bit hash per row; bit 31 is the sign."""
    rows = " UNION ALL ".join(f"SELECT {r} AS r, packet_id, h FROM ({sql})" for r, sql in enumerate(hashes))
    return f"""WITH hashed AS ({rows}), upd AS (
  SELECT r, h & 511 AS col, {sign_of("h", 31)} AS sgn
  FROM hashed JOIN events ON event_id = packet_id AND event_type <> 'error'),
cells AS (SELECT r, col, sum(sgn) AS v FROM upd GROUP BY r, col)
{CELL_ROWS}"""


# One seed per row.
ROW_SEEDS = (0x2D31E867, 0x6AD611C4, 0x00000000, 0xFFFFFFFF)
ORACLES["cs_cells_xxhash32_rows"] = _row_hash_cells([_xxhash32(seed) for seed in ROW_SEEDS])
ORACLES["cs_cells_fasthash32_rows"] = _row_hash_cells([_fasthash(seed, FASTHASH32) for seed in ROW_SEEDS])
ORACLES["packets_cells"] = ORACLES["cm_cells"]

KEYS = f"keys AS (SELECT {KEY}, count(*) AS n FROM flows GROUP BY {KEY})"


def probes(source: str, columns: str) -> str:
    """CTE ``found``: the four cells of every row of ``source``."""
    asked = " UNION ALL ".join(
        f"SELECT {columns}, {i} AS r, l{i} & 511 AS col, {sign_of(f'l{i}')} AS sgn FROM {source} JOIN lanes USING ({KEY})"
        for i in range(4)
    )
    return f"""asked AS ({asked}),
found AS (SELECT {', '.join('asked.' + c.strip() for c in columns.split(','))}, sgn, coalesce(v, 0) AS v
  FROM asked LEFT JOIN cells ON asked.r = cells.r AND asked.col = cells.col)"""


ORACLES["cm_estimate"] = with_(EV, updates(), CM_CELLS, KEYS, probes("keys", f"{KEY}, n")) + f"""
SELECT {KEY}, n, CAST(min(v) AS BIGINT) AS est FROM found GROUP BY {KEY}, n"""
ORACLES["cm_error"] = with_(LI, updates(), CM_CELLS, KEYS, probes("keys", f"{KEY}, n"),
  f"est AS (SELECT {KEY}, n, min(v) AS est FROM found GROUP BY {KEY}, n)") + """
SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS total, CAST(min(est - n) AS BIGINT) AS min_error,
       CAST(max(est - n) AS BIGINT) AS max_error, CAST(sum(est - n) AS BIGINT) AS sum_error FROM est"""
ORACLES["cs_estimate"] = with_(EV, updates(), CS_CELLS, KEYS, probes("keys", f"{KEY}, n")) + f"""
SELECT {KEY}, n, CAST(median(CAST(sgn * v AS DOUBLE)) AS DOUBLE) AS est FROM found GROUP BY {KEY}, n"""
ORACLES["cs_estimate_floor"] = with_(LI, updates(), CS_CELLS, KEYS, probes("keys", f"{KEY}, n")) + f"""
SELECT {KEY}, n, CAST(floor(median(CAST(sgn * v AS DOUBLE))) AS BIGINT) AS est FROM found GROUP BY {KEY}, n"""
ORACLES["point_query_text"] = with_(EV, updates("flows", keys="ev"), CM_CELLS,
  "asked_keys AS (SELECT * FROM ev WHERE packet_id % 11 NOT IN (1, 2, 3, 4))",
  probes("asked_keys", "packet_id")) + """
SELECT packet_id, CAST(min(v) AS BIGINT) AS est FROM found GROUP BY packet_id"""

GRID = "grid AS (SELECT r, c FROM range(4) a(r), range(512) b(c))"
ORACLES["sketch_dense"] = with_(EV, updates(), CM_CELLS, GRID) + """
SELECT CAST(0 AS INTEGER) AS layer, CAST(grid.r AS INTEGER) AS "row",
       string_agg(CAST(CAST(coalesce(v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY c) AS cells
FROM grid LEFT JOIN cells ON grid.r = cells.r AND grid.c = cells.col GROUP BY grid.r"""
ORACLES["sketch_row_arrays"] = with_(EV, updates(), "cells AS (SELECT cpu, r, col, sum(w * sgn) AS v FROM upd GROUP BY ALL)",
  "grid AS (SELECT p, r, c FROM range(4) p(p), range(4) a(r), range(512) b(c))") + """
SELECT CAST(p AS INTEGER) AS cpu, CAST(grid.r AS INTEGER) AS "row",
       string_agg(CAST(CAST(coalesce(v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY c) AS cells
FROM grid LEFT JOIN cells ON p = cpu AND grid.r = cells.r AND grid.c = cells.col GROUP BY p, grid.r"""
ORACLES["sketch_flat_index"] = with_(EV, updates(), CM_CELLS) + """
SELECT CAST(r * 512 + col AS BIGINT) AS flat, CAST(r AS INTEGER) AS "row", CAST(col AS INTEGER) AS col,
       CAST(v AS BIGINT) AS value FROM cells"""


# Counters and rates ----------------------------------------------------------------

COUNTERS = "count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes"
ORACLES["packet_byte_counts"] = with_(EV) + f"SELECT cpu, {COUNTERS} FROM flows GROUP BY cpu"
ORACLES["packet_counts"] = with_(EV) + "SELECT proto, count(*) AS packets FROM flows GROUP BY proto"
ORACLES["proto_counts"] = with_(EV) + "SELECT proto, count(*) AS packets FROM ev GROUP BY proto"

HOURLY = f"""counted AS (SELECT cpu, time_bucket(INTERVAL 1 HOUR, ts) AS ts, {COUNTERS} FROM flows GROUP BY 1, 2),
spans AS (SELECT cpu, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM counted GROUP BY cpu),
hourly AS (SELECT s.cpu, s.ts, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes
  FROM spans s LEFT JOIN counted c ON s.cpu = c.cpu AND s.ts = c.ts)"""
HOURLY_ALL = (
    HOURLY.replace("SELECT cpu, time_bucket", "SELECT CAST(0 AS INTEGER) AS cpu, time_bucket")
)
RUNNING = """totals AS (SELECT cpu, ts, CAST(sum(packets) OVER w AS BIGINT) AS packets, CAST(sum(bytes) OVER w AS BIGINT) AS bytes
  FROM hourly WINDOW w AS (PARTITION BY cpu ORDER BY ts))"""
DELTAS = """deltas AS (SELECT cpu, ts, packets - lag(packets, 1, 0) OVER (PARTITION BY cpu ORDER BY ts) AS delta,
  row_number() OVER (PARTITION BY cpu ORDER BY ts) AS i, count(*) OVER (PARTITION BY cpu) AS n
  FROM totals WHERE packets > 0)"""

ORACLES["per_second_rates"] = with_(EV, HOURLY) + """
SELECT cpu, ts, packets, bytes, (CAST(bytes AS DOUBLE) / 3600) * 8 / 1e9 AS gbps FROM hourly"""
ORACLES["counter_snapshots"] = with_(EV, HOURLY, RUNNING) + "SELECT * FROM totals"
ORACLES["counter_deltas"] = with_(EV, HOURLY, RUNNING, DELTAS) + "SELECT cpu, ts, CAST(delta AS BIGINT) AS delta FROM deltas"
ORACLES["avg_rate"] = with_(EV, HOURLY, RUNNING, DELTAS) + """
SELECT cpu, round_even(avg(delta) FILTER (WHERE i > 1), 2) AS avg_rate FROM deltas GROUP BY cpu"""
ORACLES["avg_byte_rate"] = with_(EV, HOURLY_ALL, RUNNING, DELTAS.replace("packets", "bytes")) + """
, mean AS (SELECT round_even(avg(delta) FILTER (WHERE i > 1), 2) AS avg_rate FROM deltas)
SELECT avg_rate, avg_rate * 8 / 1e9 AS avg_gbps FROM mean"""
ORACLES["peak_rate"] = with_(EV, HOURLY, RUNNING, DELTAS) + """
SELECT cpu, CAST(max(delta) FILTER (WHERE i > 2 OR i > n - 2) AS BIGINT) AS peak_rate FROM deltas GROUP BY cpu"""
ORACLES["bounded_read"] = with_(EV, HOURLY_ALL) + """
SELECT ts, packets, bytes FROM hourly, (SELECT min(ts) AS t0 FROM hourly)
WHERE ts < t0 + INTERVAL 48 HOUR AND ts > t0"""
ORACLES["throughput_units"] = with_(EV, HOURLY, RUNNING, DELTAS) + """
SELECT cpu, ts, CAST(delta AS DOUBLE) * 100 / 1e6 AS mega_units FROM deltas"""


# Sampled summaries -------------------------------------------------------------------


def threshold(p: float) -> int:
    return 1 << 32 if p >= 1 else int(4294967295 * p)


def gates(seeds: tuple[int, ...], source: str = "flows", purpose: str = "row", name: str = "u") -> str:
    """CTE ``draws_<purpose>``: uniform 32-bit values ``u`` of every (packet, seed, row)."""
    start = {
        f"g{s}_{i}": _constant(i, _constant(s, _text(purpose), False), False) for s in seeds for i in range(2)
    }
    halves = " UNION ALL ".join(
        f"SELECT packet_id, {s} AS gseed, {row} AS grow, CAST({half} AS BIGINT) AS {name} FROM d{purpose}"
        for s in seeds
        for row, half in enumerate(
            (f"g{s}_0 >> 32", f"g{s}_0 & {U32}", f"g{s}_1 >> 32", f"g{s}_1 & {U32}")
        )
    )
    return _xx_columns(f"d{purpose}", source, "packet_id", start, (True,)) + f""",
draws_{purpose} AS ({halves})"""


def sampled(p: float, seed: int = 1234) -> str:
    return gates((seed,)) + f""",
taken AS (SELECT upd.* FROM upd JOIN draws_row d ON upd.packet_id = d.packet_id AND r = grow WHERE u < {threshold(p)})"""


SAMPLED_CELLS = "cells AS (SELECT r, col, sum(sgn) AS v FROM taken GROUP BY r, col)"
ORACLES["sampled_cells"] = with_(EV, updates(), sampled(0.25), SAMPLED_CELLS) + CELL_ROWS

def md5_gate(seed: int) -> str:
    text = f"concat_ws('|', 'row', {seed}, 0, packet_id)"
    return f"CAST(('0x' || substr(md5({text}), CAST(8 * r + 1 AS BIGINT), 8)) AS BIGINT)"


ORACLES["sampled_cells_md5"] = with_(
    EV, updates(family="md5"), f"taken AS (SELECT * FROM upd WHERE {md5_gate(1234)} < {threshold(0.25)})", SAMPLED_CELLS
) + CELL_ROWS
ORACLES["sampled_estimate"] = with_(EV, updates(), sampled(0.25), SAMPLED_CELLS, KEYS, probes("keys", f"{KEY}, n")) + f"""
SELECT {KEY}, n, CAST(median(CAST(sgn * v AS DOUBLE)) / 0.25 AS DOUBLE) AS est FROM found GROUP BY {KEY}, n"""


def _sweep(ps, seeds) -> str:
    grid = ", ".join(f"({p!r}, {threshold(p)}, {s})" for p in ps for s in seeds)
    return with_(
        EV,
        updates(),
        f"runs AS (SELECT CAST(c0 AS DOUBLE) AS p, CAST(c1 AS BIGINT) AS t, CAST(c2 AS INTEGER) AS seed FROM (VALUES {grid}) g(c0, c1, c2))",
        gates(tuple(seeds)),
        "drawn AS (SELECT upd.*, gseed AS seed, u FROM upd JOIN draws_row d ON upd.packet_id = d.packet_id AND r = grow)",
        "swept AS (SELECT p, runs.seed, r, col, sum(sgn) AS v FROM drawn JOIN runs ON drawn.seed = runs.seed AND u < t GROUP BY ALL)",
        KEYS,
        f"keyrows AS (SELECT DISTINCT {KEY}, r, col, sgn FROM upd)",
        f"""found AS (SELECT {', '.join('k.' + c.strip() for c in KEY.split(','))}, runs.p, runs.seed, k.sgn, coalesce(v, 0) AS v
  FROM keyrows k CROSS JOIN runs LEFT JOIN swept s ON s.p = runs.p AND s.seed = runs.seed AND s.r = k.r AND s.col = k.col)""",
        f"est AS (SELECT {KEY}, p, seed, median(CAST(sgn * v AS DOUBLE)) / p AS est FROM found GROUP BY {KEY}, p, seed)",
    )


ORACLES["key_totals"] = with_(
    """keys AS (SELECT u AS "user", p AS peer, count(*) AS n, md5(concat_ws('|', coalesce(CAST(u AS VARCHAR), '\\N'), coalesce(CAST(p AS VARCHAR), '\\N'))) AS h
  FROM (SELECT CASE WHEN user_id % 4 <> 0 THEN user_id END AS u, CASE WHEN user_id % 4 <> 1 THEN user_id END AS p FROM events) GROUP BY ALL)""",
    """upd AS (SELECT keys.*, r, CAST('0x' || substr(h, 4 * r + 1, 4) AS BIGINT) & 511 AS col FROM keys, range(4) t(r))""",
    "counted AS (SELECT r, col, sum(n) AS v FROM upd GROUP BY ALL)",
) + """
SELECT "user", peer, n, CAST(min(v) AS BIGINT) AS est FROM upd JOIN counted USING (r, col) GROUP BY ALL"""
# The grid of probabilities and seeds.
SWEEP_P = (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
SWEEP_SEEDS = (1234, 2375, 3522, 23738, 1918)
ORACLES["sampled_sweep"] = _sweep(SWEEP_P, SWEEP_SEEDS) + f"""
SELECT p, round(avg(abs(est - n)), 6) AS mean_abs_error, round(avg(est - n), 6) AS mean_error, count(*) AS estimates
FROM est JOIN keys USING ({KEY}) GROUP BY p"""
ORACLES["sampled_run_log"] = _sweep((0.1, 0.5, 1.0), (1234, 2375)) + f"""
, hours AS (SELECT count(*) AS packets, sum(wire_len) AS bytes FROM flows GROUP BY time_bucket(INTERVAL 1 HOUR, ts))
SELECT p, seed, count(*) AS keys, CAST(sum(n) AS BIGINT) AS packets, round(avg(abs(est - n)), 6) AS mean_abs_error,
  (SELECT round(avg(packets), 6) FROM hours) AS avg_packets, (SELECT round(avg(bytes), 6) FROM hours) AS avg_bytes
FROM est JOIN keys USING ({KEY}) GROUP BY p, seed"""

SLOTS = (
    "slotids AS (SELECT block, CAST(idx AS INTEGER) AS idx"
    " FROM (SELECT DISTINCT packet_id // 64 AS block FROM flows), range(256) t(idx)),\n"
    + _xx_columns("dgap", "slotids", "block, idx", {"g": _constant(1234, _text("gap"), False)}, (True, False))
    + """,
gaps AS (SELECT block, idx, greatest(CAST(ceil(ln((CAST(g >> 32 AS DOUBLE) + 0.5) / 4294967296.0) / ln(0.75)) AS BIGINT), 1) AS gap
  FROM dgap),
walk AS (SELECT block, sum(gap) OVER (PARTITION BY block ORDER BY idx) - 1 AS pos FROM gaps),
slots AS (SELECT CAST(block * 64 + pos // 4 AS BIGINT) AS ordinal, CAST(pos % 4 AS INTEGER) AS "row" FROM walk WHERE pos < 256)"""
)
ORACLES["sampled_geometric_slots"] = with_(EV, SLOTS) + "SELECT * FROM slots"
ORACLES["sampled_geometric"] = with_(EV, updates(), SLOTS,
  'taken AS (SELECT upd.* FROM upd JOIN slots ON packet_id = ordinal AND r = "row")', SAMPLED_CELLS) + CELL_ROWS


# Layered summaries ---------------------------------------------------------------------


def layered_updates(source: str = "flows", layers: int = 16, family: str = "xx") -> str:
    deepest = f"""CASE WHEN lh & 4294967294 = 0 THEN {layers - 1}
      ELSE least((SELECT min(i) FROM range(1, 32) t(i) WHERE (lh >> CAST(i AS BIGINT)) & 1 = 1) - 1, {layers - 1}) END"""
    selects = [
        f"SELECT placed.*, {i} AS r, l{i} & 511 AS col, {sign_of(f'l{i}')} AS sgn FROM placed" for i in range(4)
    ]
    return f"""{lanes(source, family)},
placed AS (SELECT {source}.*, l0, l1, l2, l3, lh, CAST({deepest} AS INTEGER) AS deepest
  FROM {source} JOIN lanes USING ({KEY})),
upd AS ({" UNION ALL ".join(selects)})"""


LAYER_KEYS = f"keys AS (SELECT {KEY}, lh, deepest, count(*) AS n FROM upd WHERE r = 0 GROUP BY ALL)"
DEEP_CELLS = "deep AS (SELECT deepest AS layer, r, col, sum(sgn) AS v FROM upd GROUP BY ALL)"
NESTED_CELLS = """nested AS (SELECT l AS layer, r, col, sum(sgn) AS v
  FROM upd, range(16) t(l) WHERE l <= deepest GROUP BY ALL)"""
ORACLES["layered_layers"] = with_(LI, layered_updates(), LAYER_KEYS) + f"SELECT {KEY}, n, lh AS layer_hash, deepest FROM keys"
LAYER_ROWS = """SELECT CAST(layer AS INTEGER) AS layer, CAST(r AS INTEGER) AS "row", CAST(col AS INTEGER) AS col,
CAST(v AS BIGINT) AS value FROM """
ORACLES["layered_cells"] = with_(LI, layered_updates(), DEEP_CELLS) + LAYER_ROWS + "deep"
ORACLES["layered_nested"] = with_(LI, layered_updates(), NESTED_CELLS) + LAYER_ROWS + "nested"


ORACLES["layered_cells_fasthash"] = f"""WITH wide AS ({ORACLES["hash_fasthash64"]}), layer_hashes AS ({ORACLES["hash_fasthash32"]}),
hashed AS (
  SELECT packet_id, wide.h AS h, CASE WHEN l.h & 4294967294 = 0 THEN 15
    ELSE least((SELECT min(i) FROM range(1, 32) t(i) WHERE (l.h >> CAST(i AS BIGINT)) & 1 = 1) - 1, 15) END AS layer
  FROM wide JOIN layer_hashes l USING (packet_id) JOIN events ON event_id = packet_id AND event_type <> 'error'),
upd AS (SELECT layer, r, ((h >> (16 * r)) & 511) AS col, CASE WHEN ((h >> (16 * r)) & 32768) <> 0 THEN 1 ELSE -1 END AS sgn
  FROM hashed, range(4) t(r)),
deep AS (SELECT layer, r, col, sum(sgn) AS v FROM upd GROUP BY ALL)
{LAYER_ROWS}deep"""


def heaps(by: str = "", scale: str = "1", taken: str = "upd", candidates: str = "upd") -> str:
    """CTE ``heap``: the 64 largest positive estimates per layer (and ``by``)."""
    own = f"{by}, " if by else ""
    match = f" AND c.{by} = k.{by}" if by else ""
    return f"""lcells AS (SELECT {own}l AS layer, r, col, sum(sgn) AS v FROM {taken}, range(16) t(l) WHERE l <= deepest GROUP BY ALL),
cand AS (SELECT DISTINCT {own}{KEY}, deepest, l AS layer, r, col, sgn FROM {candidates}, range(16) t(l) WHERE l <= deepest),
est AS (SELECT {'k.' + by + ' AS ' + by + ', ' if by else ''}{', '.join('k.' + c.strip() for c in KEY.split(','))}, k.deepest, k.layer,
  CAST(floor(median(CAST(k.sgn * coalesce(c.v, 0) AS DOUBLE)) / {scale}) AS BIGINT) AS est
  FROM cand k LEFT JOIN lcells c ON c.layer = k.layer AND c.r = k.r AND c.col = k.col{match} GROUP BY ALL),
heap AS (SELECT {own}CAST(layer AS INTEGER) AS layer,
  CAST(row_number() OVER (PARTITION BY {own}layer ORDER BY est DESC, {KEY}) AS INTEGER) AS rank, est, {KEY}, deepest
  FROM est WHERE est > 0 QUALIFY rank <= 64)"""


HEAP_COLUMNS = f"layer, rank, est, {KEY}, deepest"
EV_HEAP = with_(EV, layered_updates(), heaps())
LI_HEAP = with_(LI, layered_updates(), heaps())
ORACLES["heavy_hitters"] = EV_HEAP + f"SELECT {HEAP_COLUMNS} FROM heap"
ORACLES["stream_heavy_hitters"] = ORACLES["heavy_hitters"]
ORACLES["heavy_hitters_md5"] = with_(EV, layered_updates(family="md5"), heaps()) + f"SELECT {HEAP_COLUMNS} FROM heap"
ORACLES["heavy_hitters_lineitem"] = LI_HEAP + f"SELECT {HEAP_COLUMNS} FROM heap"
ORACLES["top_layer_k"] = EV_HEAP + f"""
SELECT {HEAP_COLUMNS} FROM heap WHERE layer = 1 AND est <> 0 ORDER BY est DESC, {KEY} LIMIT 10"""
ORACLES["topk_merge"] = with_(EV, layered_updates(), heaps(by="cpu")) + f"""
, summed AS (SELECT layer, deepest, {KEY}, CAST(sum(est) AS BIGINT) AS est FROM heap GROUP BY layer, deepest, {KEY})
SELECT layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY est DESC, {KEY}) AS INTEGER) AS rank, est, {KEY}, deepest
FROM summed QUALIFY rank <= 64"""
ORACLES["topk_merge_exact"] = with_(EV, layered_updates(), heaps(by="cpu")) + f"""
, summed AS (SELECT CAST(layer AS INTEGER) AS layer, deepest, {KEY}, CAST(sum(est) AS BIGINT) AS est FROM est WHERE est > 0 GROUP BY ALL)
SELECT layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY est DESC, {KEY}) AS INTEGER) AS rank, est, {KEY}, deepest
FROM summed QUALIFY rank <= 64"""
ORACLES["sampled_layered"] = with_(
    EV, layered_updates(), sampled(0.5),
    gates((1234,), purpose="refresh"),
    f"""refreshed AS (SELECT upd.* FROM upd JOIN draws_refresh d ON upd.packet_id = d.packet_id AND grow = 0
  WHERE u < {threshold(0.5)})""",
    heaps(scale="0.5", taken="taken", candidates="refreshed"),
) + f"SELECT {HEAP_COLUMNS} FROM heap"


def _gsum(head: str, g: str, result: str = "coalesce(sum(y), 0.0)", name: str = "gsum") -> str:
    weight = "CASE WHEN layer < 15 AND deepest > layer THEN -1.0 ELSE 1.0 END"
    return head + f"""
, weighted AS (SELECT pow(2.0, layer) * CAST({weight} AS DOUBLE) * CAST({g} AS DOUBLE) AS y FROM heap)
SELECT CAST({result} AS DOUBLE) AS {name} FROM weighted"""


ORACLES["gsum_l1"] = _gsum(EV_HEAP, "est")
ORACLES["gsum_f2"] = _gsum(EV_HEAP, "est * est")
ORACLES["gsum_entropy"] = _gsum(EV_HEAP, "est * ln(est)", "round(coalesce(sum(y), 0.0), 4)")
ORACLES["count_distinct_gsum"] = _gsum(EV_HEAP, "sign(est)", name="distinct_keys")
ORACLES["count_distinct_gsum_lineitem"] = _gsum(LI_HEAP, "sign(est)", name="distinct_keys")


# Medians ---------------------------------------------------------------------------------

ORACLES["median_rows"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (list_sort([l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT)])[2]
 + list_sort([l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT)])[3]) / 2.0::DOUBLE AS median
FROM lineitem"""
ORACLES["median_of_five"] = """
SELECT l_orderkey, l_linenumber, l_partkey,
  list_sort([l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT), CAST(l_quantity AS BIGINT)])[3] AS median
FROM lineitem"""


# Keyed tables ------------------------------------------------------------------------------

OPS = "ops AS (SELECT event_id AS seq, user_id * 7919 + event_id AS x FROM events)"


def _keyed(size: int, value: str) -> str:
    return with_(OPS) + f"SELECT x % {size} AS key, CAST({value} AS BIGINT) AS value FROM ops GROUP BY 1"


ORACLES["keyed_inc"] = _keyed(64, "count(*)")
ORACLES["keyed_inc_first_zero"] = _keyed(8192, "count(*) - 1")
ORACLES["keyed_last_write"] = _keyed(64, "arg_max(x, seq)")
ORACLES["keyed_write_first_const"] = _keyed(8192, "CASE WHEN count(*) = 1 THEN 65244 ELSE arg_max(x, seq) END")
ORACLES["keyed_const"] = _keyed(8192, "65244")
ORACLES["keyed_lookup_default"] = with_(OPS,
  "counts AS (SELECT (o_custkey * 3) % 4096 AS key, count(*) AS value FROM orders GROUP BY 1)") + """
SELECT seq, x, coalesce(value, 0) AS value FROM ops LEFT JOIN counts ON x % 4096 = key"""
ORACLES["table_checksum"] = with_(EV) + f"""
SELECT bit_xor({hex_at(f"md5(concat_ws('|', packet_id, {KEY_TEXT}, wire_len))", 1, 15)}) AS checksum, count(*) AS n FROM ev"""


# Streams -------------------------------------------------------------------------------------

ORACLES["stream_windowed_cells"] = with_(EV, updates()) + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(0 AS INTEGER) AS layer, CAST(r AS INTEGER) AS "row",
       CAST(col AS INTEGER) AS col, CAST(sum(w) AS BIGINT) AS value
FROM upd GROUP BY ALL"""
ORACLES["stream_state_cells"] = ORACLES["stream_packets_cells"] = ORACLES["stream_cells"]
ORACLES["stream_counters"] = with_(EV) + f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, {COUNTERS} FROM flows GROUP BY 1"""
ORACLES["stream_redirect"] = with_(EV) + f"""
SELECT 'COUNTED' AS verdict, proto, {COUNTERS} FROM flows GROUP BY proto"""
