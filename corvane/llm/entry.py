"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fim, fingerprint, html, jaccard, lexical, linededup, mixing, pii, sharding, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(_table(spark, sf_dir, "pages"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(_table(spark, sf_dir, "conversations"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_html": op4_html,
    "op5_chat": op5_chat,
    "op6_fingerprint": op6_fingerprint,
    "op7_linededup": op7_linededup,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_fim": op11_fim,
    "op12_sharding": op12_sharding,
    "op13_search": op13_search,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)
), both_ways AS MATERIALIZED (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT DISTINCT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN least ON least.doc_id = w.doc_id
"""

OP2_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM bw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT k FROM pat
), occ AS (
  SELECT d.doc_id, r.i AS first, s.k AS k, p.item_id
  FROM dw d, sizes s, unnest(range(1, len(d.w) - s.k + 2)) AS r(i)
  JOIN pat p ON p.k = s.k AND p.p = array_to_string(d.w[r.i:r.i + s.k - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT first + j) AS n_hit FROM occ, unnest(range(0, k)) AS q(j) GROUP BY doc_id
), pieces AS (
  SELECT doc_id, unnest(p) AS m, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM occ))
), placed AS (
  SELECT doc_id, stop - length(m) AS a, stop AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS at FROM (
    SELECT *, sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM pieces) WHERE regexp_matches(m, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]')
), ranges AS (
  SELECT doc_id, min(a) AS a, max(b) AS b FROM (
    SELECT p.*, p.at - row_number() OVER (PARTITION BY p.doc_id ORDER BY p.at) AS island FROM placed p
    JOIN (SELECT DISTINCT doc_id, first + j AS at FROM occ, unnest(range(0, k)) AS q(j)) x ON x.doc_id = p.doc_id AND x.at = p.at) GROUP BY doc_id, island
), spans AS (
  SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM ranges GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated, coalesce(s.spans, '') AS spans
FROM dw d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id
"""

OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'assistant') AS n_assistant,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
         list(CAST(length(role) AS VARCHAR) || ':' || role || text ORDER BY turn NULLS FIRST, role, text) AS parts
  FROM t GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT c.parts[1:i] AS parts FROM c, unnest(range(1, len(c.parts))) AS r(i)
), firsts AS (
  SELECT parts, min(conv_id) AS conv_id FROM c GROUP BY parts
)
SELECT c.conv_id, c.n_turns, c.n_assistant, c.rendered FROM c JOIN firsts f ON f.conv_id = c.conv_id
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.parts = c.parts)
"""

#: The base patterns of personal data.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _pieces(text: str, pattern: str, rest: str) -> str:
    """The text cut into matches and what lies between; sums of lengths give their places."""
    return f"regexp_extract_all({text}, '(?s){pattern}|{rest}')"


def _base_sql() -> str:
    """Matches that pass: row, kind, its order, value, first and last code point (exclusive)."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    keys = {"email": "lower(m)", "ip": "m", "card": digits, "phone": digits}
    luhn = "list_sum([CASE WHEN i % 2 = 1 THEN d ELSE CASE WHEN d < 5 THEN 2 * d ELSE 2 * d - 9 END END FOR d, i IN list_transform(string_split(reverse(d), ''), lambda x: CAST(x AS INTEGER))]) % 10 = 0"
    tests = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(right('0' || ltrim(x, '0'), 4) AS INTEGER), 0) > 255)) = 0",
        "card": f"length(d) BETWEEN 16 AND 19 AND {luhn}",
        "phone": "length(d) BETWEEN 8 AND 15",
    }
    parts = []
    for k, (kind, pattern) in enumerate(_BASE.items()):
        cut = f"SELECT id, unnest({_pieces('text', pattern, '.')}) AS m, generate_subscripts({_pieces('text', pattern, '.')}, 1) AS i FROM t WHERE regexp_matches(text, '{pattern}')"
        placed = f"SELECT id, m, {digits} AS d, sum(length(m)) OVER (PARTITION BY id ORDER BY i) AS stop FROM ({cut})"
        parts.append(f"SELECT id, '{kind}' AS kind, {k} AS k, '{kind}:' || {keys[kind]} AS entity, stop - length(m) AS a, stop AS b FROM ({placed}) WHERE length(m) > 1 AND {tests[kind]}")
    return " UNION ALL ".join(parts)


OP3_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), t AS MATERIALIZED (
  SELECT min(n) AS id, text FROM docs WHERE text <> '' GROUP BY text
), base AS MATERIALIZED (
  {_base_sql()}
), held AS (
  SELECT DISTINCT id, entity FROM base
), words AS MATERIALIZED (
  SELECT id, lower(m) AS term, stop - length(m) AS a, stop AS b FROM (
    SELECT id, m, sum(length(m)) OVER (PARTITION BY id ORDER BY i) AS stop FROM (
      SELECT id, unnest({_pieces('text', r'[\p{L}]+', r'[^\p{L}]+')}) AS m, generate_subscripts({_pieces('text', r'[\p{L}]+', r'[^\p{L}]+')}, 1) AS i
      FROM t WHERE id IN (SELECT id FROM base))) WHERE regexp_matches(m, '^[\p{{L}}]')
), outside AS MATERIALIZED (
  SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = w.id AND b.a < w.b AND w.a < b.b)
), terms AS MATERIALIZED (
  SELECT DISTINCT id, term FROM outside
), counts AS MATERIALIZED (
  SELECT term, count(*) AS n_t FROM (
    SELECT id, term FROM terms UNION ALL
    SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[\p{{L}}]+'), lambda x: lower(x)))) AS term FROM t WHERE id NOT IN (SELECT id FROM base)) GROUP BY term
), entities AS (
  SELECT entity, count(*) AS n_e FROM held GROUP BY entity
), total AS (
  SELECT CAST(count(*) AS DOUBLE) AS n FROM t
), told AS MATERIALIZED (
  SELECT entity, term FROM (SELECT entity, term, count(*) AS n_et FROM held JOIN terms USING (id) GROUP BY ALL) JOIN entities USING (entity) JOIN counts USING (term), total
  WHERE log2(n / n_e) > 0 AND log2(n_et * n / (n_e * n_t)) >= 0.8 * log2(n / n_e) - 1e-9
), found AS (
  SELECT id, string_agg('term:' || a || ':' || b, ',' ORDER BY a, b) AS spans FROM outside WHERE (id, term) IN (SELECT id, term FROM held JOIN told USING (entity)) GROUP BY id
), plain AS (
  SELECT id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS spans FROM base GROUP BY id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(p.spans, '')) AS base_sha256,
       concat_ws(',', p.spans, f.spans) AS spans
FROM docs d LEFT JOIN t ON t.text = d.text LEFT JOIN plain p ON p.id = t.id LEFT JOIN found f ON f.id = t.id
"""

_SHA = "sha1(encode(coalesce(html, '')))"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) % 32, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP10_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, {_SHA} AS h, max(page_id) OVER (PARTITION BY {_SHA}) AS keeper FROM pages
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper > page_id THEN keeper END AS refers_to FROM p
"""

ORACLE: dict[str, str] = {"op3_pii": OP3_SQL, "op10_warc": OP10_SQL, "op1_jaccard": OP1_SQL, "op2_decontaminate": OP2_SQL, "op5_chat": OP5_SQL, "op9_mixing": mixing.sql(), "op11_fim": fim.sql(), "op12_sharding": sharding.sql(), "op13_search": lexical.sql()}
