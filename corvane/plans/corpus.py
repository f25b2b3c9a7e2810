"""Registered queries: intake, keys, chunks, curation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate, ingest
from ..streaming import ingest as stream
from .tables import table

FOLD = f"translate(lower({{0}}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
#: Documents seen as papers: the first line is the title, the rest the abstract.
PAPERS_SQL = """
papers AS (
  SELECT CAST(doc_id AS VARCHAR) AS bibcode, regexp_extract(coalesce(text, ''), '^[^\\n]*') AS title, 2000 + TRY_CAST(substr(source, 4) AS INTEGER) AS year,
         substr(coalesce(text, ''), length(regexp_extract(coalesce(text, ''), '^[^\\n]*')) + 2) AS abstract, source, lang FROM documents
), kept AS (
  SELECT * FROM papers WHERE length(abstract) > 0
), indexed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g') || '. ' || regexp_replace(abstract, '^\\s+|\\s+$', '', 'g'), '^[. ]+|[. ]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS content FROM kept
)"""


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the shape of raw search results."""
    text = F.coalesce("text", F.lit(""))
    title = F.regexp_extract(text, r"^[^\n]*", 0)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("bibcode"),
        F.array(title).alias("title"),
        (F.substring("source", 4, 9).try_cast("int") + 2000).cast("string").alias("year"),
        F.array("source").alias("author"),
        F.substring(text, F.length(title) + 2, F.length(text)).alias("abstract"),
        "lang",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalise(raw_papers(spark, sf_dir))


def corpus_normalize(spark, sf_dir):
    return papers(spark, sf_dir).select("bibcode", F.md5(F.col("title").cast("binary")).alias("title_md5"), "year", F.array_join("authors", ",").alias("authors"), F.length("abstract").cast("long").alias("n_abstract"))


def indexed_text(spark, sf_dir):
    c = T.indexed_text(F.col("title"), F.col("abstract"))
    return papers(spark, sf_dir).select("bibcode", F.md5(c.cast("binary")).alias("content_md5"), F.length(c).cast("long").alias("n_chars"))


def corpus_chunks(spark, sf_dir):
    return ingest.chunks(papers(spark, sf_dir)).select("chunk_id", "bibcode", "section", F.md5(F.col("content").cast("binary")).alias("content_md5"), "token_count", "chunk_index")


def _sides(spark, sf_dir):
    raw = raw_papers(spark, sf_dir)
    base = ingest.normalise(raw.where("lang = 'en'"))
    fetched = ingest.normalise(raw.where("cast(year as int) >= 2010"))
    return base, fetched


def corpus_merge(spark, sf_dir):
    base, fetched = _sides(spark, sf_dir)
    merged = ingest.merge_keep_first(base.withColumn("side", F.lit("base")), fetched.withColumn("side", F.lit("fetched")))
    return merged.select("bibcode", "year", "side")


def merge_report(spark, sf_dir):
    return ingest.merge_report(*_sides(spark, sf_dir))


def snapshot_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return ingest.repeated(docs, ["text_md5"])


def keep_first_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return ingest.keep_first(docs, ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")])


def index_key_mismatch(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    right = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"))
    return ingest.key_difference(left, right, "key")


def snapshot_hash(spark, sf_dir):
    return ingest.content_hash_tree(papers(spark, sf_dir))


def query_keys(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.format_string("q%02d", F.col("item_id")).alias("query_id"), F.col("text").alias("query"))
    return q.select(
        "query_id",
        T.kind_of(F.col("query_id")).alias("kind"),
        F.array_join(T.query_tokens(F.col("query")), " ").alias("terms"),
        T.query_slug(F.col("query")).alias("slug"),
        T.default_example_id(F.lit("lit_qa"), F.lit("eval"), F.col("query"), F.length("query") % 2 == 0).alias("example_id"),
    )


def exact_dups(spark, sf_dir):
    return curate.exact_duplicates(table(spark, sf_dir, "documents"))


def near_dups(spark, sf_dir):
    return curate.fuzzy_duplicates(table(spark, sf_dir, "documents"))


def chunk_windows(spark, sf_dir):
    c = curate.chunk_windows(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk_index", "n_tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def lang_guess(spark, sf_dir):
    return curate.guess_language(table(spark, sf_dir, "documents"))


def length_filter(spark, sf_dir):
    return curate.length_filter(table(spark, sf_dir, "documents"), 50, 5000).select("doc_id", "n_chars")


TOPICS = {"heating": "heat", "standing": "st[ae]|an$", "ordering": "or[de]"}


def topic_classes(spark, sf_dir):
    return curate.topics(table(spark, sf_dir, "documents"), TOPICS)


def clean_markup(spark, sf_dir):
    c = curate.strip_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(c).cast("long").alias("n_chars"), curate.residue(c).alias("residue"))


def split_by_family(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return curate.split_by_key(docs, F.concat_ws("|", "lang", F.col("doc_id").cast("string")))


QUOTAS = {"en": 40, "de": 30, "fr": 20, "es": 10}


def mixture_quota(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    return curate.mixture_quota(docs, "lang", QUOTAS, order).select("doc_id", "lang", "place")


def contamination(spark, sf_dir):
    return curate.shared_ngrams(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def chat_fold(spark, sf_dir):
    f = curate.fold_conversations(table(spark, sf_dir, "conversations"))
    return f.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.array_join(F.transform("loss_mask", lambda m: m.cast("string")), ",").alias("mask"))


def section_split(spark, sf_dir):
    s = curate.sections(table(spark, sf_dir, "documents"), r"\n")
    return s.select("doc_id", "section_index", F.length("content").cast("long").alias("n_chars"))


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") * 180).alias("ra"), (F.get("embedding", F.lit(1)).cast("double") * 90).alias("dec"))


def cross_match(spark, sf_dir):
    """The stated query set (ids divisible by 100) against all points, nearest within 5 degrees."""
    p = _points(spark, sf_dir)
    near = curate.within_radius(p.where("id % 100 = 0"), p, 5.0).where("left_id <> right_id").withColumn("distance", F.round("distance", 6))
    return curate.nearest(near)


def co_citation(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return curate.co_citation(edges, least=2)


def event_velocity(spark, sf_dir):
    v = curate.velocity(table(spark, sf_dir, "events"), "event_type", "ts", "day")
    return v.select("event_type", F.date_format("period", "yyyy-MM-dd").alias("period"), "n", "change")


def stream_counts(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    first, last = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    delay = f"{int((last - first).total_seconds()) + 3600 if first else 3600} seconds"  # files come in any order, so nothing is late
    events = stream.file_stream(spark, f"{sf_dir}/events.parque[t]", schema)  # a pattern takes a file and a folder alike
    out = stream.run_available(stream.windowed_counts(events, "ts", "1 hour", delay, "event_type"), spark, "ts")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def fuzzy_names(spark, sf_dir):
    """Trigram similarity of the stated query set of suppliers (keys divisible by 100) to all."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.char_ngrams(F.col("s_name")).alias("grams"))
    near = curate.similar_sets(s.where("id % 100 = 0").withColumnRenamed("id", "q"), s, 0.6)
    return near.select("q", F.col("id").alias("s_suppkey"), F.round(F.col("common") / F.col("united"), 6).alias("similarity")).where("similarity >= 0.6 and q <> s_suppkey")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_normalize, indexed_text, corpus_chunks, corpus_merge, merge_report, snapshot_duplicates, keep_first_by_source, index_key_mismatch, snapshot_hash, query_keys, exact_dups, near_dups, chunk_windows,
        lang_guess, length_filter, topic_classes, clean_markup, split_by_family, mixture_quota, contamination, chat_fold, section_split, cross_match, co_citation, event_velocity, stream_counts, fuzzy_names,
    )
}

_TOK = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+')"


def _lang_sql() -> str:
    from ..operators.curate import STOP_WORDS

    votes = ", ".join(f"len(list_intersect(w, [{', '.join(repr(x) for x in words)}])) AS {lang}" for lang, words in STOP_WORDS.items())
    best = "greatest(de, en, es, fr)"
    return f"""
SELECT doc_id, CASE WHEN {best} = 0 THEN 'und' WHEN fr = {best} THEN 'fr' WHEN es = {best} THEN 'es' WHEN en = {best} THEN 'en' ELSE 'de' END AS guess, CAST({best} AS INTEGER) AS votes
FROM (SELECT doc_id, {votes} FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) AS w FROM documents))"""


def _topic_sql() -> str:
    cells = ", ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{p}')) AS {t}" for t, p in TOPICS.items())
    best = f"greatest({', '.join(TOPICS)})"
    whens = " ".join(f"WHEN {t} = {best} THEN '{t}'" for t in TOPICS)
    return f"SELECT doc_id, CASE WHEN {best} = 0 THEN 'other' {whens} END AS topic FROM (SELECT doc_id, {cells} FROM documents)"


ORACLE = {
    "corpus_normalize": f"WITH {PAPERS_SQL} SELECT bibcode, md5(title) AS title_md5, year, source AS authors, length(abstract) AS n_abstract FROM kept",
    "indexed_text": f"WITH {PAPERS_SQL} SELECT bibcode, md5(content) AS content_md5, length(content) AS n_chars FROM indexed",
    "corpus_chunks": f"WITH {PAPERS_SQL} SELECT bibcode || ':abstract:0' AS chunk_id, bibcode, 'abstract' AS section, md5(content) AS content_md5, CAST(len([x FOR x IN regexp_split_to_array(content, '\\s+') IF x <> '']) AS BIGINT) AS token_count, 0 AS chunk_index FROM indexed",
    "corpus_merge": f"WITH {PAPERS_SQL} SELECT bibcode, year, CASE WHEN lang = 'en' THEN 'base' ELSE 'fetched' END AS side FROM kept WHERE lang = 'en' OR year >= 2010",
    "merge_report": f"WITH {PAPERS_SQL} SELECT count(*) FILTER (lang = 'en') AS n_base, count(*) FILTER (year >= 2010) AS n_fetched, count(*) FILTER (lang = 'en' AND year >= 2010) AS n_overlap, count(*) FILTER (lang = 'en' OR year >= 2010) AS n_merged, true AS superset FROM kept",
    "snapshot_duplicates": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "keep_first_by_source": "SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1",
    "index_key_mismatch": "SELECT doc_id AS key, 'right' AS missing_in FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'left' FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents)",
    "snapshot_hash": f"WITH {PAPERS_SQL}, leaves AS (SELECT substr(sha256(bibcode), 1, 3) AS b, sha256(bibcode || chr(9) || content) AS h FROM indexed), nodes AS (SELECT b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM leaves GROUP BY b) SELECT 'sha256:' || sha256(string_agg(h, '' ORDER BY b, h)) AS corpus_hash FROM nodes",
    "query_keys": """SELECT printf('q%02d', item_id) AS query_id, CASE WHEN item_id <= 18 THEN 'named' ELSE 'broad' END AS kind,
  array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS terms, substr(sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 8) AS slug,
  'lit_qa-eval-' || substr(sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 8) || CASE WHEN length(text) % 2 = 0 THEN '-neg' ELSE '' END AS example_id FROM benchmark""",
    "exact_dups": "SELECT doc_id, keeper, group_size FROM (SELECT doc_id, min(doc_id) OVER w AS keeper, count(*) OVER w AS group_size FROM documents WINDOW w AS (PARTITION BY text)) WHERE group_size > 1",
    "chunk_windows": """WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 462)) AS s FROM w)
SELECT doc_id, CAST(s / 462 AS INTEGER) AS chunk_index, CAST(len(w[s + 1:s + 512]) AS BIGINT) AS n_tokens, md5(array_to_string(w[s + 1:s + 512], ' ')) AS content_md5 FROM s WHERE s = 0 OR s + 50 < len(w)""",
    "lang_guess": _lang_sql(),
    "length_filter": "SELECT doc_id, n_chars FROM documents WHERE len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> '']) BETWEEN 50 AND 5000",
    "topic_classes": _topic_sql(),
    "split_by_family": "SELECT doc_id, lang, CASE WHEN CAST('0x' || substr(md5(lang || '|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 95 THEN 'train' ELSE 'eval' END AS split FROM documents",
    "mixture_quota": "SELECT doc_id, lang, place FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS INTEGER) AS place FROM documents) WHERE place <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 30 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 0 END",
    "contamination": f"""WITH d AS (SELECT doc_id, {_TOK.format(FOLD.format("coalesce(text, '')"))} AS w FROM documents), b AS (SELECT item_id, {_TOK.format(FOLD.format("coalesce(text, '')"))} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS r(i)), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM b, unnest(range(1, len(w) - 11)) AS r(i))
SELECT item_id, doc_id, count(*) AS n_shared FROM bg JOIN dg USING (g) GROUP BY 1, 2""",
    "near_dups": f"""WITH d AS (SELECT doc_id, {_TOK.format(FOLD.format("coalesce(text, '')"))} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id, b.doc_id AS keeper, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND b.doc_id < a.doc_id GROUP BY ALL),
near AS (SELECT m.doc_id, keeper, o / CAST(p.n + q.n - o AS DOUBLE) AS jaccard FROM met m JOIN sizes p ON p.doc_id = m.doc_id JOIN sizes q ON q.doc_id = keeper)
SELECT doc_id, min(keeper) AS keeper, arg_min(jaccard, keeper) AS jaccard FROM near WHERE jaccard >= 0.8 GROUP BY doc_id""",
    "clean_markup": rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '\\[A-Za-z]+\*?(\[[^\]]*\])?', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
e AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[{{}}]', ' ', 'g'), '[\x00-\x08\x0e-\x1f\x7f]', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS t FROM c)
SELECT page_id, length(t) AS n_chars, regexp_matches(t, '\\[A-Za-z]+|</?[A-Za-z][^>]*>') AS residue FROM e""",
    "chat_fold": "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn, role, text) AS roles, string_agg(CASE WHEN role = 'assistant' THEN 'true' ELSE 'false' END, ',' ORDER BY turn, role, text) AS mask FROM conversations GROUP BY conv_id",
    "section_split": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_index, length(l[i]) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i) WHERE length(trim(l[i])) > 0",
    "cross_match": """WITH p AS (SELECT vec_id AS id, radians(CAST(embedding[1] AS DOUBLE) * 180) AS ra, radians(CAST(embedding[2] AS DOUBLE) * 90) AS dc FROM embeddings),
m AS (SELECT a.id AS left_id, b.id AS right_id, round(degrees(2 * asin(least(1.0, sqrt(pow(sin((a.dc - b.dc) / 2), 2) + cos(a.dc) * cos(b.dc) * pow(sin((a.ra - b.ra) / 2), 2))))), 6) AS distance FROM p a, p b WHERE a.id % 100 = 0 AND a.id <> b.id)
SELECT left_id, right_id, distance FROM m WHERE distance <= 5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) = 1""",
    "co_citation": "WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.p AS a, y.p AS b, count(*) AS n FROM e x JOIN e y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2 HAVING count(*) > 1",
    "event_velocity": "SELECT event_type, strftime(period, '%Y-%m-%d') AS period, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY period) AS change FROM (SELECT event_type, date_trunc('day', ts) AS period, count(*) AS n FROM events GROUP BY 1, 2)",
    "stream_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "fuzzy_names": """WITH g AS (SELECT s_suppkey, list_distinct([substr('  ' || lower(s_name) || ' ', i, 3) FOR i IN range(1, length(s_name) + 2)]) AS g FROM supplier)
SELECT a.s_suppkey AS q, b.s_suppkey, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE), 6) AS similarity FROM g a, g b WHERE a.s_suppkey % 100 = 0 AND a.s_suppkey <> b.s_suppkey AND round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE), 6) >= 0.6""",
}
