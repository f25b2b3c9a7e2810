"""Registered queries over indexes: vectors, positions, increments and versions, citation chains; with their SQL.

Indexes are built in the shared folder from whole tables, then searched. Vector
queries are the vectors with ids divisible by 100, against all vectors; text
queries are the benchmark's items, all of them, against all documents. The
citation graph is derived from lineitem: in an order each part is followed by the
part of the next line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ann, citations, positional, ranking, segments
from ..session import scratch_path
from ..sources.versions import Versions
from . import retrieval
from .corpus import FOLD
from .retrieval import K, PLACES, docs_of, items_of
from .tables import table

NEAR, DEPTH = 8, 4


def _vectors(spark, sf_dir):
    """Queries and all vectors, and the index of these."""
    q, v = retrieval._dense_sets(spark, sf_dir)
    return q, v, ann.build(v, scratch_path(spark, "ann"))


def ann_topk(spark, sf_dir):
    q, v, index = _vectors(spark, sf_dir)
    return ann.search(index, q, v, K, decimals=PLACES).withColumn("score", F.round("score", 6))


def ann_recall(spark, sf_dir):
    """n_queries, n_indexed and recall of ``ann_topk`` against ``dense_topk``."""
    q, v, index = _vectors(spark, sf_dir)
    found = ann.search(index, q, v, K, decimals=PLACES)
    each = ann.recall(found, ranking.dense_topk(q, v, K, PLACES))
    held = index.read(ann.CODES).agg(F.sum(F.size("doc_ids")).alias("n_indexed"))
    return each.join(held).select((F.col("n") / K).cast("long").alias("n_queries"), "n_indexed", F.round("recall", 6).alias("recall"))


def _titled(spark, sf_dir):
    """Documents with their first line as title and the rest as body."""
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    return docs_of(spark, sf_dir).select("doc_id", title.alias("title"), F.substring("text", F.length(title) + 2, F.length("text")).alias("body"))


def _positions(spark, sf_dir):
    return positional.index_positions(_titled(spark, sf_dir), {"title": "A", "body": "D"})


def phrase_search(spark, sf_dir):
    """Whole items as phrases, and their first three words (as item_id + 1,000,000)."""
    items = items_of(spark, sf_dir)
    heads = items.select((F.col("query_id") + 1_000_000).alias("query_id"), F.array_join(F.slice(T.document_tokens(F.col("query")), 1, 3), " ").alias("query"))
    return positional.phrase_search(_positions(spark, sf_dir), items.unionAll(heads))


def proximity_search(spark, sf_dir):
    """An item's first and last word within NEAR positions."""
    toks = T.document_tokens(F.col("query"))
    ends = items_of(spark, sf_dir).where(F.size(toks) > 0).select("query_id", F.concat_ws(" ", F.get(toks, F.lit(0)), F.element_at(toks, -1)).alias("query"))
    return positional.near_search(_positions(spark, sf_dir), ends, NEAR)


def title_search(spark, sf_dir):
    """Items' words, in titles ten times what they are in bodies."""
    return positional.weighted_search(_positions(spark, sf_dir), items_of(spark, sf_dir), K, decimals=PLACES)


def index_refresh(spark, sf_dir):
    """Top k of an index that three increments have brought to the state of the documents table.

    First a third of the documents with another text, then a second third while the
    English ones of the first are removed, then the last and the first, as they are.
    """
    docs = docs_of(spark, sf_dir)
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    index = Versions(spark, scratch_path(spark, "segments"))
    segments.refresh(index, docs.where(third == 0).withColumn("text", F.concat(F.lit("the older text "), F.col("text"))), fan=2)
    english = table(spark, sf_dir, "documents").where((third == 0) & (F.col("lang") == "en"))
    segments.refresh(index, docs.where(third == 1), removed=english, fan=2)
    segments.refresh(index, docs.where(third != 1), fan=2)
    return segments.search(index, items_of(spark, sf_dir), K, decimals=PLACES).withColumn("score", F.round("score", 6))


def index_versions(spark, sf_dir):
    """Documents, mean length and postings of both versions of an index, the first pinned while the second is loaded."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "versions")
    ranking.build_index(docs.where("lang = 'en'"), path)
    index = Versions(spark, path)
    pinned = index.state()
    ranking.build_index(docs, path, reset=True)
    out = None
    for state in (pinned, index.state()):
        counts = index.read("postings", state).agg(F.count("*").alias("n_postings"))
        part = index.read("stats", state).join(counts).select(F.lit(state["version"]).alias("version"), "n", F.round("avgdl", 6).alias("avgdl"), "n_postings")
        out = part if out is None else out.unionAll(part)
    return out


def followed_by(spark, sf_dir):
    """source, target: parts on lines that follow each other in an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("source"), "target").distinct()


def citation_chains(spark, sf_dir):
    """Chains from the parts with keys divisible by 100, over all edges."""
    starts = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select("p_partkey")
    return citations.citation_chains(followed_by(spark, sf_dir), starts, DEPTH).withColumn("paths", F.col("paths").cast("long"))


QUERIES = {f.__name__: f for f in (ann_topk, ann_recall, phrase_search, proximity_search, title_search, index_refresh, index_versions, citation_chains)}

_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
_TOKS = f"d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(FOLD.format('text'))} AS w FROM documents), q AS MATERIALIZED (SELECT item_id AS query_id, {_WORDS.format(FOLD.format('text'))} AS w FROM benchmark)"
_TITLED = f"""t AS (SELECT doc_id, regexp_extract(text, '^[^\\n]*') AS title, text FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest({_WORDS.format(FOLD.format('title'))}) AS term, 1.0 AS weight FROM t UNION ALL SELECT doc_id, unnest({_WORDS.format(FOLD.format('substr(text, length(title) + 2)'))}), 0.1 FROM t)"""

ORACLE = {
    "phrase_search": f"""WITH {_TOKS}, ph AS (SELECT query_id, w FROM q WHERE len(w) > 0 UNION ALL SELECT query_id + 1000000, w[1:3] FROM q WHERE len(w) > 0),
s AS MATERIALIZED (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d), x AS MATERIALIZED (SELECT query_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM ph),
hit AS (SELECT query_id, doc_id, [i FOR i IN range(1, len(s.w) - len(x.w) + 2) IF s.w[i:i + len(x.w) - 1] = x.w] AS places FROM s JOIN x ON contains(s.line, x.line))
SELECT query_id, doc_id, CAST(len(places) AS INTEGER) AS n, CAST(places[1] AS INTEGER) AS first FROM hit""",
    "proximity_search": f"""WITH {_TOKS}, ends AS (SELECT query_id, w[1] AS a, w[-1] AS b FROM q WHERE len(w) > 0),
p AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS at FROM d)
SELECT query_id, x.doc_id, CAST(min(abs(x.at - y.at)) + 1 AS INTEGER) AS span FROM ends JOIN p x ON x.term = a JOIN p y ON y.term = b AND y.doc_id = x.doc_id AND abs(x.at - y.at) < {NEAR} GROUP BY query_id, x.doc_id""",
    "title_search": f"""WITH {_TITLED}, q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format(FOLD.format('text'))}) AS term FROM benchmark)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(CAST(weight AS DOUBLE)), 9) AS score FROM p JOIN q USING (term) GROUP BY ALL)) WHERE rank <= {K}""",
    "index_refresh": retrieval.ORACLE["bm25_topk"],
    "index_versions": f"""WITH {_TOKS}, b AS (SELECT 0 AS version, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id FROM documents)
SELECT version, count(*) AS n, round(avg(len(w)), 6) AS avgdl, CAST(sum(len(list_distinct(w))) AS BIGINT) AS n_postings FROM b JOIN d USING (doc_id) GROUP BY version""",
    "citation_chains": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
walks AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS hops, CAST(1 AS HUGEINT) AS paths FROM part WHERE p_partkey % 100 = 0
  UNION ALL SELECT start, target, hops + 1, CAST(sum(paths) AS HUGEINT) FROM walks JOIN e ON e.source = walks.node WHERE hops < {DEPTH} GROUP BY start, target, hops)
SELECT start, node, hops, CAST(paths AS BIGINT) AS paths FROM walks QUALIFY hops = min(hops) OVER (PARTITION BY start, node) AND hops > 0""",
}
