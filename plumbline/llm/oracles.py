"""DuckDB SQL of the operators that SQL can express."""
from __future__ import annotations

from .mixing import BLOCK_WORDS, MOST, SEED, WEIGHTS
from .quality import LEAST_WORDS, MAX_DOCUMENTS
from .sharding import SHARDS
from .turn_trie import DIGEST, GROUP, HEADS

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_table() -> list[int]:
    """The table of crc32 by its published rule: the reflected polynomial 0xEDB88320."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _crc32(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, a byte at a time."""
    pairs = f"rtrim(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')"
    values = f"list_transform(string_split({pairs}, ' '), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(a >> 8, list_extract({_crc_table()}::BIGINT[], CAST(xor(a, b) & 255 AS INT) + 1))"
    folded = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda a, b: {step}), 4294967295::BIGINT)"
    return f"CASE WHEN {text} = '' THEN 0::BIGINT ELSE {folded} END"


SHARDING = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, {_crc32("t")} AS text_crc32 FROM d),
p AS (SELECT *, row_number() OVER w AS r, sum(size) OVER w - size AS start, sum(size) OVER () AS total
  FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least({SHARDS - 1}, (2 * start + size) * {SHARDS} // (2 * total)) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all({LOWER.format("text")}, '{WORDS}') AS w FROM documents),
sh AS (SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
t AS (SELECT r, doc_id, unnest(s) AS x FROM sh WHERE doc_id IS NOT NULL),
n AS (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM sh),
k AS (SELECT x FROM t GROUP BY x HAVING count(*) > 1),
u AS (SELECT t.* FROM t JOIN k USING (x)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.r AS ra, b.r AS rb, count(*) AS c
  FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
e AS (SELECT DISTINCT p.a, p.b FROM p JOIN n x ON x.r = ra JOIN n y ON y.r = rb
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.m, n.doc_id)) AS component_id
FROM n LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON n.doc_id = m.a"""

_LINE_WORDS = f"regexp_extract_all(l, '{WORDS}')"
QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS w,
  list_filter(string_split(t, chr(10)), lambda l: len({_LINE_WORDS}) > 0) AS ls FROM d),
g AS (SELECT r, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS c FROM g),
q AS (SELECT r, count(DISTINCT i + k) AS again FROM h, range(3) o(k) WHERE c > 1 GROUP BY r),
b AS (SELECT w.r, doc_id, source, t, ls, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words
  FROM w LEFT JOIN q USING (r)),
x AS (SELECT source, t, min(doc_id) AS doc_id, any_value(ls) AS ls, count(*) AS copies FROM b GROUP BY source, t),
y AS (SELECT source, t, doc_id, copies, unnest(ls) AS l FROM x),
z AS (SELECT source, t, doc_id, copies, {LOWER.format(f"array_to_string({_LINE_WORDS}, ' ')")} AS l,
  sum(len({_LINE_WORDS})) AS n FROM y GROUP BY ALL),
f AS (SELECT source, l, arg_min(t, coalesce(doc_id, 9223372036854775807)) AS first FROM z GROUP BY source, l
  HAVING sum(copies) > {MAX_DOCUMENTS}),
lost AS (SELECT z.source, z.t, sum(n) AS lost FROM z JOIN f ON z.source IS NOT DISTINCT FROM f.source AND z.l = f.l
  WHERE z.t <> f.first GROUP BY z.source, z.t),
j AS (SELECT b.*, CAST(coalesce(lost, 0) AS BIGINT) AS removed_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM b LEFT JOIN lost ON b.source IS NOT DISTINCT FROM lost.source AND b.t = lost.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 2 * removed_words <= n_words AS kept, removed_words FROM j"""

_SIZE = f"CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT)"
MIXING = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 't') AS key, {_SIZE} AS size
  FROM documents),
st AS (SELECT *, CAST(sum(size) OVER (PARTITION BY key ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM d),
sz AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
wt AS (SELECT *, 2e0 * source_size AS cap,
  list_extract({[float(w) for w in WEIGHTS]}::DOUBLE[], CAST((row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)} AS INT) + 1) AS w FROM sz),
lv AS (SELECT *, (15e-1 * sum(source_size) OVER () - coalesce(sum(cap) OVER
    (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
tg AS (SELECT key, source_size, least(cap, w * max(level) OVER ()) AS target,
  (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks FROM lv),
qt AS (SELECT *, CASE WHEN source_size = 0 THEN 0
  ELSE CAST(least(blocks * {MOST}, round(target * blocks / source_size)) AS BIGINT) END AS quota FROM tg),
bl AS (SELECT key, unnest(range(blocks)) AS block FROM qt),
pm AS (SELECT key, block, p, row_number() OVER (PARTITION BY key, p
  ORDER BY md5('{SEED}|' || key || '|' || p || '|' || block), block) - 1 AS i FROM bl, range({MOST}) x(p)),
tk AS (SELECT key, block, count(*) AS times FROM pm JOIN qt USING (key) WHERE p * blocks + i < quota GROUP BY key, block),
pc AS (SELECT *, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block
  FROM st WHERE size > 0),
tn AS (SELECT r, sum((least(start + size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS})) * times) AS taken
  FROM pc JOIN tk USING (key, block) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM st JOIN qt USING (key) LEFT JOIN tn USING (r)"""

_CODE = "md5(length(role) || ':' || role || text)"
CONVERSATIONS = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, {_CODE} AS code, CAST(len(regexp_extract_all(text, '{WORDS}')) AS BIGINT) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_CODE}) - 1 AS pos FROM t),
i AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_crc32("name")} % {HEADS} AS h FROM i),
r AS (SELECT c.conv_id, pos, code, words FROM c JOIN o ON o.conv_id = base WHERE pos < h
  UNION ALL SELECT c.conv_id, pos + {HEADS}, code, words FROM c JOIN o USING (conv_id) WHERE pos >= h),
s AS (SELECT c.conv_id, coalesce(string_agg(code, '' ORDER BY pos), '') AS codes,
  list(words ORDER BY pos) FILTER (pos IS NOT NULL) AS words FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
u AS (SELECT *, length(codes) // {DIGEST} AS n, unnest(range(length(codes) // 32 + 1)) AS depth FROM s),
k AS (SELECT left(codes, CAST(32 * depth AS INT)) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  any_value(CASE WHEN depth > 0 THEN list_extract(words, CAST(depth AS INT)) ELSE 0 END) AS w,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM u GROUP BY ALL),
b AS (SELECT left(p, CAST(32 * (depth - 1) AS INT)) AS p, count(*) AS n FROM k WHERE depth > 0 GROUP BY 1),
x AS (SELECT k.*, coalesce(b.n, 0) AS n_children FROM k LEFT JOIN b USING (p)),
y AS (SELECT a.p, CAST(sum(CAST(z.n_children = 0 AS INT)) AS BIGINT) AS n_leaves,
  CAST(sum((z.n_convs - 1) * z.w) AS BIGINT) AS saved_tokens FROM x a JOIN x z ON starts_with(z.p, a.p) GROUP BY a.p)
SELECT x.conv_id, x.depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children, y.n_leaves, y.saved_tokens, x.ends_sha256
FROM x JOIN y USING (p) LEFT JOIN x q ON x.depth > 0 AND q.p = left(x.p, CAST(32 * (x.depth - 1) AS INT))"""

ORACLES = {
    "op1_sharding": SHARDING,
    "op6_jaccard_join": JACCARD,
    "op7_quality_rules": QUALITY,
    "op10_mixing": MIXING,
    "op13_conversation_trie": CONVERSATIONS,
}
