"""DuckDB twins of the text queries, where SQL can express them."""
from __future__ import annotations

from synthlab.llm import licences

#: CRC-32 of a text in SQL: a table built by the bitwise rule, then one fold over the bytes
_CRC_TABLE = ("SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: "
              "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x)) AS steps")

_SHARD = """list_reduce(list_transform(range({n}), lambda s: {{'u': ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' ||
 CAST(s AS VARCHAR)), 1, 13))::BIGINT, 's': s}}), lambda a, b: CASE WHEN b.u >= a.u THEN b ELSE a END).s::INTEGER"""

SHARDING = f"""
WITH crc AS ({_CRC_TABLE}),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(coalesce(text, '')) AS h
  FROM documents),
bytes AS (
  SELECT doc_id, size, h, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::BIGINT) AS codes
  FROM sized),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(codes, lambda c, b:
    xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32
  FROM bytes, crc),
placed AS (
  SELECT doc_id, size, text_crc32, {_SHARD.format(n=16)} AS shard, {_SHARD.format(n=17)} AS grown_shard FROM summed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size, text_crc32) - 1 AS slot,
  grown_shard
FROM placed
"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, count(*) OVER (PARTITION BY payload_digest) AS n
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_WORDS = ("regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text='text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 13) AS span FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, span, array_to_string(w[i:i + span - 1], ' ') AS win
  FROM (SELECT item, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM sized)),
spans AS (SELECT DISTINCT span FROM windows),
places AS (
  SELECT doc_id, span, i, array_to_string(w[i:i + span - 1], ' ') AS win
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)),
hits AS (SELECT doc_id, span, i, item FROM places JOIN windows USING (span, win)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + span)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(licences.COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"regexp_replace(replace({out}, '&', ' and '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for pattern, spelling in licences.SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(spelling)}, 'g')"
    return out


_ONE_LINE = "trim(regexp_replace({form}, '[ \\n]+', ' ', 'g'))"

LICENCES = f"""
WITH t(licence, text) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(x)})' for n, x in licences.KNOWN)}),
known AS (
  SELECT sha256(f) AS digest, min(licence) AS licence
  FROM (SELECT licence, {_ONE_LINE.format(form=_form('text'))} AS f FROM t) WHERE f <> '' GROUP BY 1),
d AS (SELECT doc_id, {_form('text')} AS form FROM documents),
w AS (SELECT doc_id, form, sha256({_ONE_LINE.format(form='form')}) AS text_digest FROM d),
lines AS (SELECT doc_id, sha256(trim(unnest(string_split(form, chr(10))))) AS digest FROM w),
n AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names
  FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, known.licence, coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notices
FROM w LEFT JOIN known ON w.text_digest = known.digest LEFT JOIN n ON w.doc_id = n.doc_id
"""

EMBEDDINGS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, x -> x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""
