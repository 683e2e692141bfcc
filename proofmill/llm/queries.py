"""The thirteen contract queries and the pipeline, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, license, lines, near, prefix_trie, quality, substring, token_files, toxicity, variants
from .common import shared_dir, table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and class_id: the least doc_id of the document's near-duplicate class."""
    return near.near_duplicates(table(spark, d, "documents"))


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines and dropped lines of each document, and the digest of what is kept."""
    out = lines.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_counts(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html.main_text(table(spark, d, "pages"))


def op6_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license.license_scan(table(spark, d, "documents")).select("doc_id", "n_paragraphs", "n_licensed", "n_unconfirmed", "n_unknown", F.array_join("families", ",").alias("families"))


def op7_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring.substring_dedup(table(spark, d, "documents"))


def op8_bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_decode(table(spark, d, "documents"), vocabulary_path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    out = quality.quality_rules(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def quality_base(spark: SparkSession, d: str) -> DataFrame:
    """The counted base rules alone, which SQL can express too."""
    return quality.base_counts(table(spark, d, "documents").select("doc_id", "text")).select("doc.doc_id", *quality.BASE, "base_failed")


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op11_token_files(spark: SparkSession, d: str) -> DataFrame:
    """Place, size and checksum of each document's ids, from the files that hold them."""
    path = f"{shared_dir(spark)}/op11-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k.json"), path)
    return token_files.token_digests(token_files.read_tokens(spark, path))


def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, d, "conversations"))


def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_groups(table(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_line_dedup, op3_token_counts, op4_decontamination, op5_html_extraction, op6_license_scan, op7_substring_dedup, op8_bpe_round_trip, op9_quality_rules, op10_toxicity, op11_token_files, op12_prefix_trie, op13_spelling_variants, quality_base, pipeline)
}

#: Words of the near-duplicate and benchmark queries, in DuckDB's pattern syntax.
_PLAIN = "[^\\x20\\x09-\\x0D]+"
_BENCH = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of the 32-bit checksum, and the checksum of a text's UTF-8 bytes with it.
_CRC_TABLE = """tb(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM tb WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM tb WHERE k = 8)"""


def _crc(text: str) -> str:
    byte = f"list_transform(range(0, strlen({text})), lambda j: ('0x' || hex(encode({text}))[2 * j + 1:2 * j + 2])::BIGINT)"
    return f"xor(list_reduce({byte}, lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]), 4294967295), 4294967295)"


ORACLE = {
    "op13_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
z AS (SELECT w, d || w AS z FROM r), h AS (SELECT w, {_crc("z")} AS h FROM z, crc),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word FROM h),
words AS (SELECT word, count(*) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, b.word, b.n FROM x JOIN words b ON b.word = x.rest UNION SELECT b.word, x.word, x.n FROM x JOIN words b ON b.word = x.rest),
best AS (SELECT word, count(*) AS n_near, list({{'m': -near_n, 'w': near}} ORDER BY -near_n, near)[1] AS b FROM near GROUP BY word),
f AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * n THEN b.w END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM words LEFT JOIN best USING (word)),
go AS (SELECT word, word AS at, form AS onward FROM f UNION ALL SELECT go.word, f.word, f.form FROM go JOIN f ON f.word = go.onward)
SELECT f.word, f.form, go.at AS root, f.n, f.n_near, f.form_n FROM f JOIN go ON go.word = f.word AND go.onward IS NULL""",
    "op12_prefix_trie": f"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, list({{'r': r, 's': s}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || s)) AS ks
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS s FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
hs AS (SELECT conv_id, ks, conv_id::VARCHAR AS z FROM o), ph AS (SELECT conv_id, ks, {_crc("z")} % 4 AS h FROM hs, crc),
r AS (SELECT x.conv_id, list_concat(coalesce(y.ks, [])[1:h], x.ks[h + 1:]) AS ks FROM ph x LEFT JOIN o y ON y.conv_id = x.conv_id - x.conv_id % 20),
p AS (SELECT conv_id, d, ks[1:d] AS path, d = len(ks) AS ends FROM r, unnest(range(0, len(ks) + 1)) AS t(d)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.path[d].s, '{_PLAIN}')) ELSE 0 END AS saved FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM v, unnest(range(0, d + 1)) AS t(a) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(v.e) AS ends_sha256
FROM v JOIN s ON s.path = v.path LEFT JOIN n u ON v.d > 0 AND u.path = v.path[1:v.d - 1]""",
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 5 * c >= 4 * (x.n + y.n - c)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node)
SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node""",
    "op2_line_dedup": f"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS missing, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, i - 1 AS lno, regexp_extract_all(ls[i], '{_PLAIN}') AS ws FROM r, unnest(range(1, len(ls) + 1)) AS t(i)),
m AS (SELECT doc_id, text, lno, len(ws) AS n, list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ts FROM l WHERE len(ws) > 0),
u AS (SELECT DISTINCT text, n, ts FROM m),
c AS (SELECT n, ts, count(*) AS docs FROM u GROUP BY ALL),
lf AS (SELECT n, ts[1:3] AS lead FROM c WHERE docs < {lines.MIN_DOCS} GROUP BY ALL HAVING sum(docs) >= {lines.MIN_DOCS} AND count(*) > 1),
loose AS (SELECT u.* FROM u JOIN c USING (n, ts) JOIN lf ON lf.n = u.n AND lf.lead = u.ts[1:3] WHERE c.docs < {lines.MIN_DOCS} AND u.n >= {lines.LEAST}),
cl AS (SELECT text, n, ts, a, b, list_filter(ts, lambda x, i: i <= 3 OR 5 * (i - 4) // (n - 3) NOT IN (a, b)) AS fast FROM loose, range(4) AS x(a), range(5) AS y(b) WHERE a < b),
met AS (SELECT n, a, b, fast FROM cl GROUP BY ALL HAVING count(DISTINCT text) >= {lines.MIN_DOCS}),
clm AS (SELECT cl.* FROM cl JOIN met USING (n, a, b, fast)),
ex AS (SELECT u.text, u.n, u.ts FROM u JOIN c USING (n, ts) WHERE c.docs >= {lines.MIN_DOCS}),
sh AS (SELECT text, sum(n) AS shared, count(*) AS others FROM (SELECT text, n, ts FROM ex UNION SELECT text, n, ts FROM clm) GROUP BY text),
wd AS (SELECT text, sum(n) AS total, sum(n) - any_value(shared) AS own, any_value(others) AS others FROM u JOIN sh USING (text) GROUP BY text),
one AS (SELECT ts FROM ex JOIN wd USING (text) WHERE own > 0 AND (2 * own >= total - n OR others <= {lines.FEW}) GROUP BY n, ts HAVING count(*) >= {lines.MIN_DOCS}),
many AS (SELECT n, a, b, fast FROM (SELECT n, a, b, fast, text, sum(n) AS w FROM clm GROUP BY ALL) JOIN wd USING (text) WHERE own > 0 AND (2 * own >= total - w OR others <= {lines.FEW}) GROUP BY n, a, b, fast HAVING count(*) >= {lines.MIN_DOCS}),
dr AS (SELECT ts FROM one UNION SELECT ts FROM clm JOIN many USING (n, a, b, fast)),
h AS (SELECT doc_id, list(lno) AS ats FROM m WHERE ts IN (SELECT ts FROM dr) GROUP BY doc_id)
SELECT doc_id, CASE WHEN missing THEN 0 ELSE len(ls) END AS n_lines, coalesce(len(ats), 0) AS n_dropped,
  sha256(CASE WHEN ats IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(ats, i - 1)), chr(10)), '') END) AS kept_sha256 FROM r LEFT JOIN h USING (doc_id)""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BENCH}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_BENCH}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, ws[i:i + 12] AS w FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(w) AS k FROM win),
occ AS (SELECT doc_id, i, k, ws[i:i + k - 1] AS w FROM d, sizes, unnest(range(1, len(ws) - k + 2)) AS t(i)),
hit AS (SELECT occ.doc_id, occ.i, occ.k, win.item_id FROM occ JOIN win ON occ.w = win.w),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "quality_base": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'w': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) AS x FROM d),
g AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.w) AS c FROM w),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(3) AS y(k) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(list_aggregate(ws, 'string_agg', ''))::BIGINT AS word_chars, len(regexp_extract_all(d.text, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
  list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '{_PLAIN}')) AS ls, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2 * (256 + {substring.LENGTH - 1})) AS h FROM d, unnest(range(0, length(h) // 2, 256)) AS t(j)),
g AS (SELECT doc_id, j + i AS i, substr(h, 2 * i - 1, {2 * substring.LENGTH}) AS s FROM c, unnest(range(1, least(256, length(h) // 2 - {substring.LENGTH} + 1) + 1)) AS t(i)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT g.doc_id, g.i, lag(g.i) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS before FROM g JOIN m ON m.s = g.s AND m.first < g.doc_id),
y AS (SELECT doc_id, i, sum(CASE WHEN i - before <= {substring.LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
z AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM (SELECT doc_id, min(i) AS a, max(i) + {substring.LENGTH - 1} AS b FROM y GROUP BY doc_id, run)),
k AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e - 1)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM z JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
