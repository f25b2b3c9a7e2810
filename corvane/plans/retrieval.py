"""Registered queries: lexical, dense and hybrid retrieval and its evaluation, with their SQL.

Text queries are the benchmark's items, all of them, against all documents; the
vector of item i stands in by the embedding of vec_id i. Dense queries on their
own are the vectors with ids divisible by 100, against all vectors. Gold of an
item is every document that contains its text; gold of a vector is its label.
Scores are rounded to nine places before ranking, so that both engines break
ties alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ireval, ranking, stats
from ..session import materialize
from . import evaluation
from .corpus import FOLD
from .tables import table

PLACES, K, POOL, DEEP = 9, 10, 50, 500
WHOLE = 10_000
#: Pairs of an item and a document that are broadcast to the texts; two numbers each.
FOUND = 2_000_000
POOLS = [50, 100, 200, DEEP]


def kind():
    return F.when(F.col("query_id") <= 18, "named").otherwise("broad")


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query and vector of every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "query_id")


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vectors_of(spark, sf_dir):
    """Vectors of the ids that documents have too."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return v.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


def items_of(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus_of(spark, sf_dir):
    """Postings of the items' words and (n, avgdl): every readout's only tokenising of the documents."""
    items = items_of(spark, sf_dir)
    words = items.select(F.explode_outer(T.document_tokens(F.col("query"))).alias("term")).where("term is not null")
    return ranking.cut_postings(ranking.query_terms(items).select("term").unionAll(words).distinct(), docs_of(spark, sf_dir))


def gold_of(spark, sf_dir, post):
    """query_id, doc_id: documents that contain an item verbatim.

    A document that does has every word of the item but the first and last,
    which may be parts of its words. So the item's rarest inner word finds the
    candidates in the postings, and ``contains`` decides. Items without an inner
    word are looked for in every document, all of them in one pass.
    """
    items, docs = items_of(spark, sf_dir), docs_of(spark, sf_dir)
    toks = T.document_tokens(F.col("query"))
    split = items.select("query_id", "query", F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0))).alias("inner"))
    inner = split.select("query_id", "query", F.explode("inner").alias("term"))
    df = ranking.document_frequency(post)
    rarest = inner.join(df, "term", "left").groupBy("query_id", "query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select("query_id", "query", "r.term")
    pairs = materialize(post.select("doc_id", "term").join(ranking.small(rarest), "term").select("query_id", "doc_id").distinct(), "pairs")
    texts = rarest.select("query_id", "query")
    if pairs.limit(FOUND + 1).count() <= FOUND:
        found = docs.join(F.broadcast(pairs), "doc_id").join(ranking.small(texts), "query_id")
    else:
        found = pairs.join(ranking.small(texts), "query_id").join(docs, "doc_id")
    out = found.where(F.contains("text", "query")).select("query_id", "doc_id")
    whole = split.where(F.size("inner") == 0).select("query_id", "query")
    n = whole.count()
    for block in range(-(-n // WHOLE)):  # items of two words at most, WHOLE of them a pass
        mine = whole if n <= WHOLE else whole.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // WHOLE))) == block)
        every = mine.agg(F.collect_list(F.struct("query_id", "query")).alias("items"))
        hits = F.filter("items", lambda i: F.contains(F.col("text"), i["query"]))
        out = out.unionAll(docs.join(F.broadcast(every)).select("doc_id", F.explode(hits).alias("i")).select("i.query_id", "doc_id"))
    return out


def heads_of(spark, sf_dir, corpus, k=POOL):
    return ranking.head_rankings(queries_of(spark, sf_dir), vectors_of(spark, sf_dir), *corpus, k, PLACES)


def scored_of(spark, sf_dir, k=K, pool=POOL):
    corpus = corpus_of(spark, sf_dir)
    ranks = ireval.with_hybrid(heads_of(spark, sf_dir, corpus, pool), pool)
    return ireval.per_query(ireval.gold_ranks(gold_of(spark, sf_dir, corpus[0]), ranks), k)


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def doc_stats(spark, sf_dir):
    return _r(ranking.corpus_stats(docs_of(spark, sf_dir)), "avgdl")


def term_df(spark, sf_dir):
    return ranking.document_frequency(ranking.postings(docs_of(spark, sf_dir)))


def bm25_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _r(ranking.lexical_topk(q, docs_of(spark, sf_dir), K, decimals=PLACES), "score")


def bm25_eval(spark, sf_dir):
    corpus = corpus_of(spark, sf_dir)
    scored = ranking.bm25_of_postings(ranking.query_terms(items_of(spark, sf_dir)), *corpus, PLACES)
    top = ranking.ranked(scored, [F.col("score"), F.col("doc_id")], K).select("query_id", "doc_id", "rank")
    found = gold_of(spark, sf_dir, corpus[0]).join(top, ["query_id", "doc_id"], "left")
    each = found.groupBy("query_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("rr"))
    return _r(each.agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr")), "recall", "mrr")


def _dense_sets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def dense_topk(spark, sf_dir):
    return _r(ranking.dense_topk(*_dense_sets(spark, sf_dir), K, PLACES), "score")


def dense_eval(spark, sf_dir):
    q, v = _dense_sets(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    top = ranking.dense_topk(q, v, K, PLACES, others=True)
    own = labels.toDF("query_id", "own")
    each = top.join(labels, "doc_id").join(own, "query_id").groupBy("query_id").agg((F.count_if(F.col("label") == F.col("own")) / F.count("*")).alias("p"), F.coalesce(F.lit(1.0) / F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    return _r(each.agg(F.count("*").alias("n"), F.avg("p").alias("precision"), F.avg("rr").alias("mrr")), "precision", "mrr")


def rrf_topk(spark, sf_dir):
    return ranking.retrieve(queries_of(spark, sf_dir), docs_of(spark, sf_dir), vectors_of(spark, sf_dir), "hybrid", K, POOL, PLACES)


def weighted_fusion(spark, sf_dir):
    q = queries_of(spark, sf_dir)
    d = ranking.dense_topk(q, vectors_of(spark, sf_dir), POOL, PLACES)
    x = ranking.lexical_topk(q, docs_of(spark, sf_dir), POOL, decimals=PLACES)
    return _r(ranking.weighted_fusion(d, x, K, decimals=PLACES), "score")


def arm_metrics(spark, sf_dir):
    return _r(ireval.arm_table(scored_of(spark, sf_dir), kind()), "recall", "mrr", "pool_recall")


def complementarity(spark, sf_dir):
    return _r(ireval.complementarity(scored_of(spark, sf_dir), kind()), "union_recall", "dense_recall", "gain")


def decisive_queries(spark, sf_dir):
    return ireval.decisive(scored_of(spark, sf_dir)).select("query_id", "dense_first", "lexical_first", "hybrid_first")


def candidate_size(spark, sf_dir):
    return ireval.candidates(ireval.with_hybrid(heads_of(spark, sf_dir, corpus_of(spark, sf_dir)), POOL))


def best_gold_rank(spark, sf_dir):
    corpus, queries = corpus_of(spark, sf_dir), queries_of(spark, sf_dir)
    gold = materialize(gold_of(spark, sf_dir, corpus[0]), "gold")
    dense = ranking.best_dense_ranks(queries, vectors_of(spark, sf_dir), gold, "dense_best", PLACES)
    lexical = ranking.best_lexical_ranks(ranking.query_terms(queries), *corpus, gold, "lexical_best", PLACES)
    return ireval.best_gold_rank(gold, dense, lexical)


def pool_sweep(spark, sf_dir):
    corpus = corpus_of(spark, sf_dir)
    out = ireval.pool_sweep(heads_of(spark, sf_dir, corpus, DEEP), gold_of(spark, sf_dir, corpus[0]), POOLS, kind())
    return _r(out, "union_recall", "fused_low", "fused_high", "gap_low", "gap_high", "mean_candidates")


def ndcg(spark, sf_dir):
    corpus = corpus_of(spark, sf_dir)
    ranks = ireval.with_hybrid(heads_of(spark, sf_dir, corpus), POOL)
    return _r(ireval.ndcg(ireval.gold_ranks(gold_of(spark, sf_dir, corpus[0]), ranks), "hybrid_rank", K), "ndcg")


def fielded_bm25(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    docs = docs_of(spark, sf_dir).select("doc_id", title.alias("title"), F.substring("text", F.length(title) + 2, F.length("text")).alias("body"))
    return _r(ranking.fielded_bm25(q, docs, {"title": 2.0, "body": 1.0}, K, PLACES), "score")


def recency_topk(spark, sf_dir):
    q, v = _dense_sets(spark, sf_dir)
    weight = ranking.half_life_weight(F.pmod("doc_id", F.lit(30)).cast("double"), 10.0)
    return _r(ranking.dense_topk(q, v, K, PLACES, weight), "score")


def rerank_topk(spark, sf_dir):
    """Second stage stand-in: shared word 3-grams of the item and the candidate."""
    from ..operators.curate import shared_ngrams

    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    first = ranking.lexical_topk(q, docs_of(spark, sf_dir), POOL, decimals=PLACES).withColumn("score", -F.col("score"))
    second = shared_ngrams(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), 3).select(F.col("item_id").alias("query_id"), "doc_id", F.col("n_shared").alias("score2"))
    return _r(ranking.rerank(first, second, K), "score").select("query_id", "doc_id", "score", "score2", "rank")


def abstentions(spark, sf_dir):
    q, v = _dense_sets(spark, sf_dir)
    return ranking.abstain(q, ranking.dense_topk(q, v, K, PLACES), 0.5)


RULES = [("the [a-z]+ing", "catalog"), (" de | la ", "archive")]


def query_routing(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ranking.route(q, RULES, "papers")


def query_expansion(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    aliases = table(spark, sf_dir, "nation").select(F.lit("the").alias("term"), F.lower("n_name").alias("alias"))
    return ranking.expand(q, aliases).select("query_id", F.md5(F.col("query").cast("binary")).alias("query_md5"))


def abstention_quality(spark, sf_dir):
    """Precision and recall of the quality label, read off by a length rule."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _r(ireval.confusion(d, F.col("quality") == 1, F.col("n_chars") >= 200), "precision", "recall", "f1")


def _values(scored: DataFrame, pairs: bool = False) -> DataFrame:
    return evaluation.values_of(scored, kind(), pairs)


def bootstrap_ci(spark, sf_dir):
    """Intervals of every arm, slice and metric."""
    return _r(stats.bootstrap(_values(scored_of(spark, sf_dir)), ["arm", "slice", "metric"]), "mean", "lo", "hi")


def paired_ci(spark, sf_dir):
    """Intervals of the differences of two arms, in every slice and metric."""
    out = stats.bootstrap(_values(scored_of(spark, sf_dir), pairs=True), ["arm", "slice", "metric"])
    return _r(out.withColumn("includes_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0)), "mean", "lo", "hi")


def loo_stability(spark, sf_dir):
    v = scored_of(spark, sf_dir).select(F.col("query_id").alias("id"), (F.col("lexical_recall") - F.col("dense_recall")).alias("value"))
    return _r(stats.leave_one_out(materialize(v, "diffs")).withColumn("left_out", F.col("left_out").cast("string")), "mean", "lo", "hi")


def bootstrap_numpy(spark, sf_dir):
    """The whole grid from one generator: arms, then pairs, by slice and metric."""
    scored = materialize(scored_of(spark, sf_dir), "scored")
    return _r(evaluation.grid(scored, kind()), "mean", "lo", "hi")


def pool_ci(spark, sf_dir):
    """Paired intervals of recall against the hybrid arm, a fresh generator each, with leave-one-out, at every pool."""
    corpus = corpus_of(spark, sf_dir)
    heads, gold = heads_of(spark, sf_dir, corpus, DEEP), materialize(gold_of(spark, sf_dir, corpus[0]), "gold")
    return _r(evaluation.pool_intervals(heads, gold, POOLS, K), "mean", "lo", "hi")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_eval, doc_stats, term_df, dense_topk, dense_eval, rrf_topk, weighted_fusion, arm_metrics, complementarity, decisive_queries, candidate_size, best_gold_rank, pool_sweep, ndcg,
        fielded_bm25, recency_topk, rerank_topk, abstentions, query_routing, query_expansion, abstention_quality, bootstrap_ci, paired_ci, loo_stability, bootstrap_numpy, pool_ci,
    )
}


def _bm25_sql(name: str, text: str = "text", queries: str = "benchmark") -> str:
    toks = f"regexp_extract_all({FOLD.format(f'coalesce({text}, chr(32))')}, '[\\p{{L}}\\p{{N}}]+')"
    return f"""
{name}_d AS MATERIALIZED (SELECT doc_id, {toks} AS w FROM {'docs' if text != 'text' else 'documents'}),
{name}_st AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_d),
{name}_q AS MATERIALIZED (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {queries}) GROUP BY ALL),
{name}_p AS MATERIALIZED (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_w AS MATERIALIZED (SELECT query_id, q.term, qf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS w FROM {name}_q q JOIN (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1) f ON f.term = q.term, {name}_st),
{name} AS MATERIALIZED (SELECT query_id, doc_id, -sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS raw FROM {name}_p p JOIN {name}_w w ON w.term = p.term, {name}_st GROUP BY 1, 2)"""


_LEX = _bm25_sql("bm") + ", lex AS MATERIALIZED (SELECT query_id, doc_id, round(raw, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9), doc_id) AS rank FROM bm)"
_COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
_DEN = f"""den AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.item_id AS query_id, v.vec_id AS doc_id, round({_COS.format('qe.embedding', 'v.embedding')}, 9) AS score FROM benchmark q JOIN embeddings qe ON qe.vec_id = q.item_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)))"""
_DEN100 = f"""d100 AS MATERIALIZED (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round({_COS.format('q.embedding', 'v.embedding')}, 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""
_GOLD = "gold AS MATERIALIZED (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_QS = "lexq AS MATERIALIZED (SELECT l.* FROM lex l WHERE query_id IN (SELECT vec_id FROM embeddings))"


def _fused_sql(pool: int, name: str = "fus") -> str:
    return f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, doc_id) AS hybrid_rank FROM (
  SELECT query_id, doc_id, d.rank AS dense_rank, l.rank AS lexical_rank, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 9) AS score
  FROM (SELECT * FROM den WHERE rank <= {pool}) d FULL JOIN (SELECT * FROM lexq WHERE rank <= {pool}) l USING (query_id, doc_id)))"""


_SCORED = """scored AS MATERIALIZED (SELECT query_id, CASE WHEN query_id <= 18 THEN 'named' ELSE 'broad' END AS kind, count(*) AS n_gold,
  count(*) FILTER (dense_rank <= 10) / count(*) AS dense_recall, coalesce(1.0 / min(dense_rank) FILTER (dense_rank <= 10), 0) AS dense_rr, min(dense_rank) FILTER (dense_rank <= 10) AS dense_first, count(dense_rank) / count(*) AS dense_pool,
  count(*) FILTER (lexical_rank <= 10) / count(*) AS lexical_recall, coalesce(1.0 / min(lexical_rank) FILTER (lexical_rank <= 10), 0) AS lexical_rr, min(lexical_rank) FILTER (lexical_rank <= 10) AS lexical_first, count(lexical_rank) / count(*) AS lexical_pool,
  count(*) FILTER (hybrid_rank <= 10) / count(*) AS hybrid_recall, coalesce(1.0 / min(hybrid_rank) FILTER (hybrid_rank <= 10), 0) AS hybrid_rr, min(hybrid_rank) FILTER (hybrid_rank <= 10) AS hybrid_first, count(hybrid_rank) / count(*) AS hybrid_pool,
  count(*) FILTER (dense_rank IS NOT NULL AND lexical_rank IS NULL) AS dense_only, count(*) FILTER (dense_rank IS NULL AND lexical_rank IS NOT NULL) AS lexical_only, count(*) FILTER (dense_rank IS NOT NULL AND lexical_rank IS NOT NULL) AS both,
  count(*) FILTER (dense_rank IS NULL AND lexical_rank IS NULL) AS neither, count(hybrid_rank) / count(*) AS union_recall
  FROM gold LEFT JOIN fus USING (query_id, doc_id) GROUP BY query_id)"""
_EVAL = ", ".join([_LEX.strip(), _QS, _DEN, _fused_sql(50), _GOLD, _SCORED])
_SLICES = "(SELECT *, unnest(['all', kind]) AS slice FROM scored)"


def _arms_sql() -> str:
    return " UNION ALL ".join(f"SELECT slice, '{a}' AS arm, count(*) AS n, round(avg({a}_recall), 6) AS recall, round(avg({a}_rr), 6) AS mrr, round(avg({a}_pool), 6) AS pool_recall FROM {_SLICES} GROUP BY slice" for a in ("dense", "lexical", "hybrid"))


def _sweep_sql() -> str:
    parts = []
    for p in (50, 100, 200, 500):
        parts.append(
            f"""SELECT {p} AS pool, slice, count(*) AS n, round(avg(u), 6) AS union_recall, round(avg(lo), 6) AS fused_low, round(avg(hi), 6) AS fused_high, round(avg(u - lo), 6) AS gap_low, round(avg(u - hi), 6) AS gap_high,
  CAST(sum(d) AS BIGINT) AS dense_only, CAST(sum(l) AS BIGINT) AS lexical_only, CAST(sum(b) AS BIGINT) AS both, CAST(sum(x) AS BIGINT) AS neither, round(avg(c), 6) AS mean_candidates
  FROM (SELECT *, unnest(['all', CASE WHEN query_id <= 18 THEN 'named' ELSE 'broad' END]) AS slice FROM (
    SELECT g.query_id, count(hybrid_rank) / count(*) AS u, count(*) FILTER (hybrid_rank <= 10) / count(*) AS lo, count(*) FILTER (hybrid_rank <= 50) / count(*) AS hi,
      count(*) FILTER (dense_rank IS NOT NULL AND lexical_rank IS NULL) AS d, count(*) FILTER (dense_rank IS NULL AND lexical_rank IS NOT NULL) AS l, count(*) FILTER (dense_rank IS NOT NULL AND lexical_rank IS NOT NULL) AS b,
      count(*) FILTER (hybrid_rank IS NULL) AS x, coalesce(any_value(k.c), 0) AS c
    FROM gold g LEFT JOIN f{p} USING (query_id, doc_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM f{p} GROUP BY 1) k ON k.query_id = g.query_id GROUP BY g.query_id)) GROUP BY slice"""
        )
    ctes = ", ".join([_LEX.strip(), _QS, _DEN, *[_fused_sql(p, f"f{p}") for p in (50, 100, 200, 500)], _GOLD])
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


_DOCS = "docs AS (SELECT doc_id, regexp_extract(text, '^[^\\n]*') AS title, substr(text, length(regexp_extract(text, '^[^\\n]*')) + 2) AS body FROM documents)"
_BOOT = """, boot AS (SELECT grp, rep, any_value(n) AS n, any_value(mean) AS mean, avg(v[1 + CAST('0x' || substr(md5('20260531|' || rep || '|' || i), 1, 8) AS BIGINT) % n]) AS m
  FROM (SELECT grp, list(value ORDER BY id) AS v, count(*) AS n, avg(value) AS mean FROM vals GROUP BY grp), unnest(range(0, 10000)) AS r(rep), unnest(range(0, n)) AS s(i) GROUP BY grp, rep)
"""
_CI = "any_value(n) AS n, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi"



def _arm_values(pairs: bool = False) -> str:
    names = evaluation.PAIRS if pairs else {a: (a, None) for a in ireval.ARM_RANKS}
    value = lambda x, y, m: f"{x}_{m}" + (f" - {y}_{m}" if y else "")
    return " UNION ALL ".join(f"SELECT {{'arm': '{a}', 'slice': slice, 'metric': '{m}'}} AS grp, query_id AS id, {value(*xy, m)} AS value FROM {_SLICES}" for a, xy in names.items() for m in evaluation.METRICS)


ORACLE = {
    "bm25_topk": f"WITH {_LEX} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10",
    "bm25_eval": f"WITH {_LEX}, {_GOLD} SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM (SELECT query_id, count(rank) / count(*) AS recall, coalesce(1.0 / min(rank), 0) AS rr FROM gold LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) USING (query_id, doc_id) GROUP BY 1)",
    "doc_stats": f"WITH {_bm25_sql('bm')} SELECT n, round(avgdl, 6) AS avgdl FROM bm_st",
    "term_df": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents) GROUP BY 1",
    "dense_topk": f"WITH {_DEN100} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d100) WHERE rank <= 10",
    "dense_eval": f"WITH {_DEN100}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d100 WHERE query_id <> doc_id QUALIFY rank <= 10) SELECT count(*) AS n, round(avg(p), 6) AS precision, round(avg(rr), 6) AS mrr FROM (SELECT query_id, count(*) FILTER (a.label = b.label) / count(*) AS p, coalesce(1.0 / min(rank) FILTER (a.label = b.label), 0) AS rr FROM top JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id GROUP BY 1)",
    "rrf_topk": f"WITH {', '.join([_LEX.strip(), _QS, _DEN, _fused_sql(50)])} SELECT query_id, hybrid_rank AS rank, doc_id, round(score, 6) AS score, dense_rank, lexical_rank FROM fus WHERE hybrid_rank <= 10",
    "weighted_fusion": f"""WITH {', '.join([_LEX.strip(), _QS, _DEN])},
d AS (SELECT query_id, doc_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS ds FROM den WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
l AS (SELECT query_id, doc_id, coalesce((-score - min(-score) OVER w) / nullif(max(-score) OVER w - min(-score) OVER w, 0), 1) AS ls FROM lexq WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(coalesce(ds, 0) * 0.7 + coalesce(ls, 0) * (1 - 0.7), 9) AS score FROM d FULL JOIN l USING (query_id, doc_id))) WHERE rank <= 10""",
    "arm_metrics": f"WITH {_EVAL} {_arms_sql()}",
    "complementarity": f'''WITH {_EVAL} SELECT slice, CAST(sum(dense_only) AS BIGINT) AS dense_only, CAST(sum(lexical_only) AS BIGINT) AS lexical_only, CAST(sum("both") AS BIGINT) AS "both", CAST(sum(neither) AS BIGINT) AS neither, round(avg(union_recall), 6) AS union_recall, round(avg(dense_pool), 6) AS dense_recall, round(avg(union_recall) - avg(dense_pool), 6) AS gain FROM {_SLICES} GROUP BY slice''',
    "decisive_queries": f"WITH {_EVAL} SELECT query_id, dense_first, lexical_first, hybrid_first FROM scored WHERE NOT ((dense_first IS NULL) = (lexical_first IS NULL) AND (lexical_first IS NULL) = (hybrid_first IS NULL))",
    "candidate_size": f"WITH {', '.join([_LEX.strip(), _QS, _DEN, _fused_sql(50)])} SELECT query_id, count(*) AS n_candidates FROM fus GROUP BY 1",
    "best_gold_rank": f"WITH {', '.join([_LEX.strip(), _QS, _DEN, _GOLD])} SELECT query_id, min(d.rank) AS dense_best, min(l.rank) AS lexical_best FROM gold LEFT JOIN den d USING (query_id, doc_id) LEFT JOIN lexq l USING (query_id, doc_id) GROUP BY 1",
    "pool_sweep": _sweep_sql(),
    "ndcg": f"WITH {', '.join([_LEX.strip(), _QS, _DEN, _fused_sql(50), _GOLD])} SELECT query_id, round(sum(CASE WHEN hybrid_rank <= 10 THEN 1 / log2(hybrid_rank + 1) ELSE 0 END) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(count(*), 10) + 1)]), 6) AS ndcg FROM gold LEFT JOIN fus USING (query_id, doc_id) GROUP BY 1",
    "fielded_bm25": f"WITH {_DOCS}, {_bm25_sql('bt', 'title')}, {_bm25_sql('bb', 'body')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM (SELECT query_id, doc_id, raw * 2 AS s FROM bt UNION ALL SELECT query_id, doc_id, raw FROM bb) GROUP BY 1, 2)) WHERE rank <= 10",
    "recency_topk": f"WITH {_DEN100} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score * pow(0.5, (doc_id % 30) / 10.0), 9) AS score FROM d100)) WHERE rank <= 10",
    "rerank_topk": f"""WITH {_LEX}, dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM bm_d, unnest(range(1, len(w) - 1)) AS r(i)),
bg AS (SELECT DISTINCT item_id AS query_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT item_id, regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark), unnest(range(1, len(w) - 1)) AS r(i)),
s2 AS (SELECT query_id, doc_id, count(*) AS score2 FROM bg JOIN dg USING (g) GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, score2, rank FROM (SELECT query_id, doc_id, -score AS score, score2, row_number() OVER (PARTITION BY query_id ORDER BY score2 DESC NULLS LAST, -score DESC, doc_id) AS rank FROM (SELECT * FROM lex WHERE rank <= 50) LEFT JOIN s2 USING (query_id, doc_id)) WHERE rank <= 10""",
    "abstentions": f"WITH {_DEN100}, top AS (SELECT query_id, score FROM d100 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10) SELECT query_id, count(*) FILTER (score > 0.5) AS n_relevant, count(*) FILTER (score > 0.5) < 2 AS abstain FROM top GROUP BY 1",
    "query_routing": "SELECT item_id AS query_id, CASE WHEN regexp_matches(lower(text), 'the [a-z]+ing') THEN 'catalog' WHEN regexp_matches(lower(text), ' de | la ') THEN 'archive' ELSE 'papers' END AS source FROM benchmark",
    "query_expansion": "WITH a AS (SELECT string_agg(n, ' ' ORDER BY n) AS more FROM (SELECT DISTINCT lower(n_name) AS n FROM nation)) SELECT item_id AS query_id, md5(text || CASE WHEN list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') THEN ' ' || more ELSE '' END) AS query_md5 FROM benchmark, a",
    "abstention_quality": "SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT count(*) FILTER (quality = 1 AND n_chars >= 200) AS tp, count(*) FILTER (quality <> 1 AND n_chars >= 200) AS fp, count(*) FILTER (quality = 1 AND n_chars < 200) AS fn, count(*) FILTER (quality <> 1 AND n_chars < 200) AS tn FROM documents JOIN labels USING (doc_id))",
    "bootstrap_ci": f"WITH {_EVAL}, vals AS ({_arm_values()}){_BOOT} SELECT grp.arm AS arm, grp.slice AS slice, grp.metric AS metric, {_CI} FROM boot GROUP BY grp",
    "paired_ci": f"WITH {_EVAL}, vals AS ({_arm_values(True)}){_BOOT} SELECT *, lo <= 0 AND hi >= 0 AS includes_zero FROM (SELECT grp.arm AS arm, grp.slice AS slice, grp.metric AS metric, {_CI} FROM boot GROUP BY grp)",
    "loo_stability": f"WITH {_EVAL}, vals AS (SELECT CAST(o.query_id AS VARCHAR) AS grp, s.query_id AS id, s.lexical_recall - s.dense_recall AS value FROM scored s JOIN scored o ON o.query_id <> s.query_id){_BOOT} SELECT *, lo > 0 OR hi < 0 AS excludes_zero FROM (SELECT grp AS left_out, {_CI} FROM boot GROUP BY grp)",
}
