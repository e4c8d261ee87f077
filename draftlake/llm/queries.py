"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from draftlake.llm.counting import op12_token_counts
from draftlake.llm.licences import op2_licences
from draftlake.llm.lines import op1_line_dedup
from draftlake.llm.manifest import op13_manifest
from draftlake.llm.middle import op11_fill_in_middle
from draftlake.llm.neighbours import op3_ngram_join
from draftlake.llm.packing import op4_packing
from draftlake.llm.pieces import op6_pieces
from draftlake.llm.quality import op8_quality
from draftlake.llm.secrets import op5_secrets
from draftlake.llm.sharding import op9_sharding
from draftlake.llm.topk import op7_topk
from draftlake.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_licences": op2_licences,
    "op3_ngram_join": op3_ngram_join,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_pieces": op6_pieces,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_manifest": op13_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

#: Lines that have an earlier line with a Jaccard similarity of 0.8 or more go.
ORACLES["op1_line_dedup"] = r"""
WITH texts AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, n - 1 AS line, parts[n] AS x,
         list_sort(list_distinct(list_filter(regexp_split_to_array(parts[n], '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS words
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM texts))),
sets AS (
  SELECT words, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, l := line))) AS id, len(words) AS size
  FROM lines WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT id, size, unnest(words) AS w FROM sets),
freq AS (SELECT w, count(*) AS n FROM tokens GROUP BY w),
ranked AS (SELECT id, size, t.w, row_number() OVER (PARTITION BY id ORDER BY n, t.w) AS pos FROM tokens t JOIN freq USING (w)),
prefix AS (SELECT * FROM ranked WHERE pos <= size - ceil(0.8 * size - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT a.id AS first, b.id AS later FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id
  AND a.size >= 0.8 * b.size - 1e-9 AND b.size >= 0.8 * a.size - 1e-9),
gone AS (
  SELECT DISTINCT p.later FROM pairs p JOIN sets a ON a.id = p.first JOIN sets b ON b.id = p.later
  WHERE len(list_intersect(a.words, b.words)) >= 0.8 * (a.size + b.size - len(list_intersect(a.words, b.words))) - 1e-9),
marked AS (
  SELECT l.doc_id, l.line, l.x, s.id IS NOT NULL AND (g.later IS NOT NULL OR row_number() OVER (PARTITION BY l.words ORDER BY l.doc_id, l.line) > 1) AS goes
  FROM lines l LEFT JOIN sets s ON s.words = l.words LEFT JOIN gone g ON g.later = s.id)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT goes), '') AS text,
       CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (goes) AS INTEGER) AS n_removed
FROM marked GROUP BY doc_id
"""

_SPANS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
}


def _kind_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, {number} AS number, '{kind}' AS kind, pos AS start, pos + len AS stop FROM (
    SELECT r, len, size, sum(gap + before) OVER (PARTITION BY r ORDER BY i) AS pos FROM (
      SELECT r, i, length(m[i]) AS len, length(t[i]) AS size, length(g[i]) AS gap, CASE WHEN i > 1 THEN length(m[i - 1]) ELSE 0 END AS before
      FROM (SELECT r, m, t, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS t, regexp_split_to_array(text, '{quoted}') AS g FROM d)))
  ) WHERE size >= {least}"""


#: A match starts after the texts between matches up to it and the matches before it.
ORACLES["op5_secrets"] = (
    "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ("
    + "\n  UNION ALL".join(_kind_sql(i, k, *v) for i, (k, v) in enumerate(_SPANS.items()))
    + """)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, number) FILTER (number < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, number) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (r) GROUP BY r
"""
)

ORACLES["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: Shards by the middle of each row's bytes in the order of doc_id; CRC-32 byte by byte.
ORACLES["op9_sharding"] = """
WITH RECURSIVE steps(n, c, i) AS (
  SELECT n, n, 0 FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
lookup AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
codes AS (SELECT doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda x: CAST(('0x' || x) AS BIGINT)) AS b FROM d),
sums AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS crc FROM codes, lookup),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, crc) AS n FROM sums),
dealt AS (SELECT *, least((16 * (2 * start + size)) // (2 * total), 15) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
"""

#: The cuts by the hash of 1: and the number; the text that comes back is the text.
ORACLES["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, CAST(('0x' || h[1:8]) AS BIGINT) % (n + 1) AS x, CAST(('0x' || h[9:16]) AS BIGINT) % (n + 1) AS y, CAST(('0x' || h[17:24]) AS BIGINT) AS h3, CAST(('0x' || h[25:32]) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256 FROM p
"""

#: Levels of a source's tree, and of the tree of sources, that the SQL has room for: 16^6 nodes each.
_LEVELS = 6


def _tree_sql(name: str) -> str:
    """From {name}0 (g, pos, n, h): a level's runs {name}_r1, the next level {name}1, and so on."""
    return "".join(
        f"""{name}_r{i + 1} AS MATERIALIZED (SELECT g, pos // 16 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {name}{i} GROUP BY ALL),
{name}{i + 1} AS (SELECT g, run AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}_r{i + 1}),
"""
        for i in range(_LEVELS)
    )


def _climb_sql(name: str, out: str, start: str) -> str:
    """From {out}0 = start (with g, pos, siblings, f): siblings and folded hashes up to the top."""
    sql = f"{out}0 AS ({start}),\n"
    for i in range(_LEVELS):
        before, after = (f"array_to_string(hs[{a}], '')" for a in ("1:pos % 16", "pos % 16 + 2:"))
        sql += f"""{out}{i + 1} AS (SELECT t.* REPLACE (t.pos // 16 AS pos, CASE WHEN r.n > 1 THEN siblings || {before} || {after} ELSE siblings END AS siblings,
  CASE WHEN r.n > 1 THEN sha256({before} || f || {after}) ELSE f END AS f) FROM {out}{i} t JOIN {name}_r{i + 1} r ON r.g = t.g AND r.run = t.pos // 16),
"""
    return sql


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in fields) + ")"


#: CRC-32 of the number's digits byte by byte; then both trees level by level.
ORACLES["op13_manifest"] = f"""
WITH RECURSIVE steps(n, c, i) AS (
  SELECT n, n, 0 FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
lookup AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8),
d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS crc FROM documents, lookup),
l AS MATERIALIZED (SELECT doc_id, {_leaf_sql('text')} AS leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
  CASE WHEN crc % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql('text')} END AS other FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
a0 AS (SELECT g, pos, n, leaf AS h FROM p),
{_tree_sql('a')}s AS MATERIALIZED (SELECT g, h AS subroot FROM a{_LEVELS}),
b0 AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, subroot AS h FROM s),
{_tree_sql('b')}{_climb_sql('a', 'x', "SELECT doc_id, leaf, g, pos, '' AS siblings, other AS f FROM p")}
{_climb_sql('b', 'y', f"SELECT x.* REPLACE (0 AS g, x.g AS pos), subroot FROM x{_LEVELS} x JOIN s USING (g)")}
root AS (SELECT h AS root FROM b{_LEVELS})
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, f AS folded_root, f = root AS verified FROM y{_LEVELS}, root
"""
