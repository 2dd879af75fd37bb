"""SQL for the queries of this package that SQL can express. Numbers are written out, not imported."""

ORACLES: dict[str, str] = {}

ORACLES["op6_host_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls, t, source FROM d),
g AS (
  SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
g2 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY doc_id
),
ln AS (SELECT doc_id, unnest(ls) AS l FROM w),
dl AS (
  SELECT doc_id, sum(n - 1) AS n FROM (
    SELECT doc_id, l, count(*) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l
  ) GROUP BY doc_id
),
c AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dl ON w.doc_id = dl.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id
),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
           OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS any_failed
  FROM c
),
h AS (SELECT source, count(*) AS docs, sum(any_failed::INT) AS failed FROM f GROUP BY source),
m AS (SELECT sum(docs) AS docs, sum(failed)::DOUBLE / sum(docs) AS mean, count(*) AS hosts FROM h),
v AS (
  SELECT any_value(mean) AS mean,
         greatest(sum(h.docs * (failed / h.docs - mean) * (failed / h.docs - mean)) / any_value(m.docs)
                  - any_value(mean * (1 - mean) * hosts / m.docs), any_value(mean * (1 - mean)) / 1e6) AS variance
  FROM h, m
),
s AS (SELECT mean, greatest(mean * (1 - mean) / variance - 1, 1e-6) AS strength FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.failed + mean * strength) / (h.docs + strength) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, s
"""

ORACLES["op9_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (
  SELECT doc_id, p, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % 1024 AS slot
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS clamp, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (
  SELECT *, clamp / weight AS ratio,
         coalesce(sum(clamp) OVER before, 0) AS held, sum(weight) OVER (ORDER BY clamp / weight DESC, source ROWS UNBOUNDED PRECEDING) AS open
  FROM r WINDOW before AS (ORDER BY clamp / weight, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
lv AS (
  SELECT arg_min((3 * (SELECT sum(source_size) FROM s) - 2 * held) / (2 * open), ratio) AS level FROM o
  WHERE (3 * (SELECT sum(source_size) FROM s) - 2 * held) / (2 * open) <= ratio
),
t AS (
  SELECT source, source_size, CASE WHEN clamp < level * weight THEN clamp::DOUBLE ELSE level * weight END AS target FROM r, lv
),
a AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
),
c AS (SELECT source, slot, sum(size) AS words FROM d GROUP BY source, slot),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY slot) AS upto FROM c),
e AS (
  SELECT u.source, slot AS edge, (target - whole * source_size - (upto - words)) / words AS part,
         row_number() OVER (PARTITION BY u.source ORDER BY slot) AS n
  FROM u JOIN a ON u.source IS NOT DISTINCT FROM a.source WHERE upto > target - whole * source_size
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN slot < edge THEN 1 ELSE 0 END)
            + CASE WHEN slot = edge THEN floor(size * part) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source
LEFT JOIN (SELECT * FROM e WHERE n = 1) e ON d.source IS NOT DISTINCT FROM e.source
"""


def _licences() -> str:
    """The known texts are the data of the query; how they are made canonical is written anew in SQL."""
    from tallyweave.llm.known_licences import NOTICES, TEXTS

    def rows(known: tuple) -> str:
        return ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in known)

    steps = (
        ("licence", "license"), ("licencing", "licensing"), ("organisation", "organization"),
        ("merchantibility", "merchantability"), ("authorisation", "authorization"), ("authorised", "authorized"),
        ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("per cent", "percent"),
        ("sub license", "sublicense"), ("https", "http"),
    )
    spaced = (
        r"regexp_replace(lower(coalesce(body, '')), "
        r"'[\x00-\x09\x0B-\x20!-/:-@\[-`{-\x7F\x{a0}\x{a9}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2026}]+', ' ', 'g')"
    )
    for a, b in steps:
        spaced = f"replace({spaced}, '{a}', '{b}')"
    left_out = r"^(copyright( c)? |c )[0-9]{4}|^copyright( c)? (by )?(the )?[^ ]*( authors| holders)?$|^all rights reserved$"
    lines = (
        f"list_filter(list_transform(string_split({spaced}, chr(10)), lambda l: trim(l, ' ')), "
        f"lambda l: l <> '' AND NOT regexp_matches(l, '{left_out}'))"
    )
    return f"""
WITH n AS (SELECT * FROM (VALUES {rows(NOTICES)}) AS v(license, body)),
t AS (SELECT * FROM (VALUES {rows(TEXTS)}) AS v(license, body) UNION ALL SELECT * FROM n),
nl AS (SELECT license, array_to_string({lines}, ' ') AS line FROM n),
tl AS (SELECT license, sha256(array_to_string({lines}, ' ')) AS known FROM t),
d AS (SELECT doc_id, {lines} AS ls FROM (SELECT doc_id, text AS body FROM documents)),
f AS (SELECT doc_id, list(DISTINCT nl.license ORDER BY nl.license) AS names
      FROM (SELECT doc_id, unnest(ls) AS line FROM d) l JOIN nl ON l.line = nl.line GROUP BY doc_id)
SELECT d.doc_id, sha256(array_to_string(ls, ' ')) AS digest, tl.license, coalesce(array_to_string(f.names, ','), '') AS notices,
       CAST(coalesce(len(f.names), 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN tl ON sha256(array_to_string(ls, ' ')) = tl.known LEFT JOIN f ON d.doc_id = f.doc_id
"""


ORACLES["op2_licences"] = _licences()

ORACLES["op4_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS set_
  FROM d
),
n AS (SELECT doc_id, CAST(len(set_) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(set_) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(reach) FROM r WHERE r.id = n.doc_id) AS component_id FROM n
"""

ORACLES["op12_prefix_trie"] = r"""
WITH c AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base, CAST(xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, b: xor(xor(x, b) // 2, 3988292384 * (xor(x, b) % 2))), 4294967295) % 4 AS INTEGER) AS h
  FROM c
),
s AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), coalesce(h.own[h.h + 1:], [])) AS turns
  FROM h LEFT JOIN c b ON b.conv_id = h.base
),
p AS (SELECT conv_id, len(turns) AS total, unnest(range(0, len(turns) + 1)) AS depth, turns FROM s),
k AS (SELECT conv_id, total, CAST(depth AS BIGINT) AS depth, turns[1:depth] AS path, turns[1:depth - 1] AS up FROM p),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, CAST(count(*) AS BIGINT) AS n_convs, min(up) AS up,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS saved,
    max(total) = depth AS leaf
  FROM k GROUP BY depth, path
),
kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY depth, up),
below AS (
  SELECT a.depth, a.path, sum(CASE WHEN b.leaf THEN 1 ELSE 0 END) AS leaves, sum(b.saved) AS saved
  FROM (SELECT depth, path, saved, leaf, unnest(range(0, depth + 1)) AS above FROM n) b
  JOIN n a ON a.depth = b.above AND a.path = b.path[1:b.above] GROUP BY a.depth, a.path
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN below ON below.depth = n.depth AND below.path = n.path
LEFT JOIN kids ON kids.depth = n.depth AND kids.path = n.path
LEFT JOIN n up ON up.depth = n.depth - 1 AND up.path = n.up
"""
