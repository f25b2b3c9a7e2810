"""Dense, lexical and hybrid ranking of a corpus for whole batches of queries.

Query sets are small next to the corpus. They are broadcast when their size is
known to be under ``BROADCAST_ROWS`` rows, or vectors in blocks of
``BROADCAST_BYTES`` (``nearest``: of rows and bytes); a larger set is joined in blocks or by shuffle, with the same
result. Ranks are cut by a group limit before the
shuffle, so no more than k rows of a query leave each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import RRF_K, document_tokens, query_tokens
from ..functions.vectors import dot, norm
from ..session import materialize, release, spread, tidy
from ..sources.schemas import ARMS
from . import blocks, nearest, packed

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20
#: Pairs of a posting and a query's word that a task scores.
PAIRS = 2_000_000


def ranked(scored: DataFrame, order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """Rows with their place in each query's order, the first ``k`` of them."""
    out = scored.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


# ---------------------------------------------------------------- lexical


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and how often the query has it."""
    each = queries.select("query_id", F.explode_outer(query_tokens(F.col("query"))).alias("term")).where("term is not null")
    return each.groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def tokenised(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, toks and len of every document."""
    docs = spread(docs.select("doc_id", F.col(text).alias("text")))
    return docs.select("doc_id", document_tokens(F.col("text")).alias("toks")).withColumn("len", F.size("toks").cast("long"))


def terms_of(toks: DataFrame) -> DataFrame:
    """doc_id, len and term of every token.

    An outer explode: for an inner one Spark infers a filter on the array's
    size, which would tokenise every text a second time.
    """
    return toks.select("doc_id", "len", F.explode_outer("toks").alias("term")).where("term is not null")


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term, tf and len: the inverted index, to be written by term."""
    return terms_of(tokenised(docs, text)).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n and avgdl."""
    return tokenised(docs, text).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    kept = packed.packed_of(post)
    return kept.frequency if kept else post.groupBy("term").agg(F.count("*").alias("df"))


#: Marks one row of each document in cut postings; no token is empty.
EVERY = ""


def cut_postings(wanted: DataFrame, docs: DataFrame, text: str = "text") -> tuple[DataFrame, tuple]:
    """Postings of the terms ``wanted``, from a scratch table, and (n, avgdl) of all documents.

    The texts are tokenised once, and the index of a whole corpus is never shuffled for
    a query set: up to ``BROADCAST_ROWS`` terms are looked up where a text is read
    (``packed``), more are joined before they are counted.
    """
    terms = wanted.select("term").where("term is not null").distinct().limit(BROADCAST_ROWS + 1).toArrow()
    if terms.num_rows > BROADCAST_ROWS:
        return _joined_postings(wanted, docs, text)
    table = packed.pack(spread(docs.select("doc_id", F.col(text).alias("text"))), terms.column("term").combine_chunks())
    stats = table.agg(F.count("*"), F.sum("len") / F.count("*")).first()
    return packed.postings(table, terms.column("term").combine_chunks(), small), stats


def _joined_postings(wanted: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, tuple]:
    """:func:`cut_postings` for any number of terms: one marked row of each document carries its length."""
    spark = docs.sparkSession
    marked = wanted.select("term").unionAll(spark.range(1).select(F.lit(EVERY).alias("term"))).distinct()
    toks = tokenised(docs, text)
    each = toks.select("doc_id", "len", F.explode_outer(F.concat(F.array(F.lit(EVERY)), "toks")).alias("term"))
    counted = each.join(small(marked), "term").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    table = materialize(counted, "postings")
    # rows that share a doc_id and a length are counted in tf
    stats = table.where(F.col("term") == EVERY).agg(F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).first()
    return table.where(F.col("term") != EVERY), stats


def bm25(queries: DataFrame, docs: DataFrame, text: str = "text", decimals: int | None = None) -> DataFrame:
    """query_id, doc_id and score (lower is better) of every matching pair."""
    terms = query_terms(queries)
    return bm25_of_postings(terms, *cut_postings(terms, docs, text), decimals)


def term_weights(terms: DataFrame, post: DataFrame, stats: tuple) -> DataFrame:
    """query_id, term, df and w: the idf times the query's count; a scratch table."""
    idf = F.log((F.lit(float(stats[0] or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)) * F.col("qf")
    return materialize(terms.join(document_frequency(post), "term").select("query_id", "term", "df", weight.alias("w")), "weights")


def bm25_of_postings(terms: DataFrame, post: DataFrame, stats: tuple, decimals: int | None = None, only: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Scores from postings (doc_id, len, term, tf) and (n, avgdl).

    A query's words meet most documents, so there are far more pairs than postings.
    The postings are dealt by document, ``PAIRS`` pairs a task; pairs are
    made and summed within the task, and :func:`ranked` cuts them there. ``only`` has
    the pairs (query_id, doc_id) to score, by default all; ``weights``, those of all documents, are those of ``post`` by default.
    """
    avgdl = stats[1] or 1.0
    spark = post.sparkSession
    weights = term_weights(terms, post, stats) if weights is None else weights
    tf = F.col("tf").cast("double")
    part = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(avgdl)))
    total = F.sum(part)
    total = total if decimals is None else F.round(total, decimals)
    if only is not None:
        pairs = only.select("query_id", "doc_id").distinct().join(post, "doc_id")
        return pairs.join(weights, ["query_id", "term"]).groupBy("query_id", "doc_id").agg((-total).alias("score"))
    rows, met = weights.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    weights = weights.select("query_id", "term", "w")
    if rows > BROADCAST_ROWS:
        return post.join(weights, "term").groupBy("query_id", "doc_id").agg((-total).alias("score"))
    post = post.repartition(max(spark.sparkContext.defaultParallelism, -(-met // PAIRS)), "doc_id")
    return post.join(F.broadcast(weights), "term").groupBy("query_id", "doc_id").agg((-total).alias("score"))


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int, text: str = "text", decimals: int | None = None) -> DataFrame:
    """query_id, doc_id, score and rank; ties by doc_id."""
    return ranked(bm25(queries, docs, text, decimals), [F.col("score"), F.col("doc_id")], k)


# ---------------------------------------------------------------- dense


def query_blocks(q: DataFrame) -> int:
    """Blocks of query vectors (qv) that are broadcast one at a time, by their bytes."""
    rows, width = q.agg(F.count("*"), F.coalesce(F.max(F.size("qv")), F.lit(0))).first()
    return max(1, -(-rows * (width * 8 + 64) // BROADCAST_BYTES))


def dense_scores(queries: DataFrame, vectors: DataFrame, decimals: int | None = None) -> DataFrame:
    """query_id, doc_id and cosine of each query (query_id, vector) with every vector.

    A stated query set against all rows: one block of queries at a time is
    broadcast to the vectors, which are read once for each block.
    """
    q = queries.select("query_id", F.col("vector").alias("qv")).withColumn("qn", norm(F.col("qv")))
    v = spread(vectors.select("doc_id", "vector")).withColumn("vn", norm(F.col("vector")))
    blocks = query_blocks(q)
    sim = F.try_divide(dot(F.col("qv"), F.col("vector")), F.col("qn") * F.col("vn"))
    sim = sim if decimals is None else F.round(sim, decimals)
    out = None
    for b in range(blocks):
        block = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = v.join(F.broadcast(block)).select("query_id", "doc_id", sim.alias("score"))
        out = part if out is None else out.unionAll(part)
    return out.where("score is not null")


def _whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, IntegralType)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, decimals: int | None = None, weight: Column | None = None, others: bool = False) -> DataFrame:
    """query_id, doc_id, score and rank; ties by doc_id.

    ``weight``, an expression over doc_id, is multiplied with the rounded cosine;
    ``others`` leaves out the vectors with the query's own id. Where ids are whole
    numbers the scores come from matrix products (``nearest``), else from a join.
    """
    order = [F.desc("score"), F.col("doc_id")]
    if _whole(vectors, "doc_id") and (not others or _whole(queries, "query_id")):
        return ranked(nearest.heads(queries, vectors, k, decimals, weight, others), order, k)
    scored = dense_scores(queries, vectors, decimals)
    scored = scored.where("query_id <> doc_id") if others else scored
    if weight is not None:
        s = F.col("score") * weight
        scored = scored.withColumn("score", s if decimals is None else F.round(s, decimals))
    return ranked(scored, order, k)


# ---------------------------------------------------------------- fusion


def fuse(dense: DataFrame, lexical: DataFrame, k: int | None = None, decimals: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two rank tables (query_id, doc_id, rank).

    Returns query_id, doc_id, score, dense_rank, lexical_rank and rank. Equal
    scores are ordered by dense rank (absent last), then by lexical rank.
    """
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col(c)), F.lit(0.0))
    score = part("dense_rank") + part("lexical_rank")
    met = d.join(x, ["query_id", "doc_id"], "full_outer").withColumn("score", score if decimals is None else F.round(score, decimals))
    order = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.col("doc_id")]
    return ranked(met.select("query_id", "doc_id", "score", "dense_rank", "lexical_rank"), order, k)


def weighted_fusion(dense: DataFrame, lexical: DataFrame, k: int | None = None, weight: float = 0.7, decimals: int | None = None) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each query and arm; absent is 0."""
    w = Window.partitionBy("query_id")
    scaled = lambda s: F.coalesce(F.try_divide(s - F.min(s).over(w), F.max(s).over(w) - F.min(s).over(w)), F.lit(1.0))
    d = dense.select("query_id", "doc_id", scaled(F.col("score")).alias("ds"))
    x = lexical.select("query_id", "doc_id", scaled(-F.col("score")).alias("ls"))
    total = F.coalesce("ds", F.lit(0.0)) * weight + F.coalesce("ls", F.lit(0.0)) * (1 - weight)
    met = d.join(x, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", (total if decimals is None else F.round(total, decimals)).alias("score"))
    return ranked(met, [F.desc("score"), F.col("doc_id")], k)


def retrieve(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None = None, arm: str = "hybrid", k: int = 10, pool: int = 50, decimals: int | None = None) -> DataFrame:
    """Top ``k`` of an arm: query_id, rank, doc_id, score, dense_rank, lexical_rank.

    ``queries`` has query_id, query and, for dense arms, vector; ``pool`` is at
    least k. The score is rounded to six places after ranking.
    """
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm!r}; one of {', '.join(ARMS)}")
    pool = max(pool, k)
    none = F.lit(None).cast("int")
    if arm == "lexical":
        out = lexical_topk(queries, docs, k, decimals=decimals).withColumns({"dense_rank": none, "lexical_rank": F.col("rank")})
    elif arm == "dense":
        out = dense_topk(queries, vectors, k, decimals).withColumns({"dense_rank": F.col("rank"), "lexical_rank": none})
    else:
        out = fuse(dense_topk(queries, vectors, pool, decimals), lexical_topk(queries, docs, pool, decimals=decimals), k, decimals)
    return out.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "dense_rank", "lexical_rank")


def hybrid_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 10, pool: int = 50) -> DataFrame:
    """The hybrid arm with its score under the older name rrf_score."""
    return retrieve(queries, docs, vectors, "hybrid", k, pool).withColumnRenamed("score", "rrf_score")


def build_index(docs: DataFrame, path: str, reset: bool = False) -> int:
    """Write postings (sorted by term within files) and corpus statistics as one version of ``path``; returns its number.

    Both tables appear together or not at all (``sources.versions``). Texts are read once and postings
    shuffled once, in blocks (``blocks``). For
    increments see :mod:`corvane.operators.segments`.
    """
    from ..sources.versions import Versions

    index = Versions(docs.sparkSession, path)
    base = index.state()["version"]
    if base >= 0 and not reset:
        raise ValueError(f"{path} already exists; reset to load it again")
    docs = docs.select("doc_id", "text")
    staged = _staged(index, docs)
    tidy(docs.sparkSession)  # blocks that were shuffled are not read again
    tokens = index.read("postings", {"tables": {"postings": staged}}).agg(F.sum("tf").cast("double").alias("tokens"))
    stats = docs.agg(F.count("*").alias("n")).join(tokens).select("n", F.try_divide(F.coalesce("tokens", F.lit(0.0)), "n").alias("avgdl"))
    return index.commit({"postings": staged, "stats": index.stage(stats, "stats")}, base)


def _staged(index, docs: DataFrame) -> dict:
    """The postings of docs (doc_id, text), written for a version of ``index``; rows of one doc_id and length are one document."""
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again"))
    if not again.limit(1).count():
        return index.stage(blocks.by_term(docs), "postings")
    again = materialize(again, "repeated")
    twice, same = small(again), F.col("doc_id").eqNullSafe(F.col("again"))
    merged = postings(docs.join(twice, same, "left_semi")).select("doc_id", "len", "term", "tf")
    posts = blocks.by_term(docs.join(twice, same, "left_anti")).unionAll(merged.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
    staged = index.stage(posts, "postings")
    release(again)
    return staged


def index_postings(queries: DataFrame, path: str, version: int | None = None) -> tuple[DataFrame, tuple]:
    """The postings of the queries' terms, and (n, avgdl), of one version of an index; files are pruned by term."""
    from ..sources.versions import Versions

    index = Versions(queries.sparkSession, path)
    state = index.state(version)
    terms = query_terms(queries).select("term").distinct()
    return index.read("postings", state).join(small(terms), "term", "left_semi"), index.read("stats", state).first()


def search_index(queries: DataFrame, path: str, k: int, version: int | None = None) -> DataFrame:
    """Lexical top k from one version of an index, by default the last."""
    scored = bm25_of_postings(query_terms(queries), *index_postings(queries, path, version))
    return ranked(scored, [F.col("score"), F.col("doc_id")], k)


# ---------------------------------------------------------------- declared refinements


def fielded_bm25(queries: DataFrame, docs: DataFrame, fields: dict[str, float], k: int, decimals: int | None = None) -> DataFrame:
    """Weighted sum of the fields' BM25 scores (lower is better)."""
    parts = None
    for field, weight in fields.items():
        part = bm25(queries, docs, field).select("query_id", "doc_id", (F.col("score") * weight).alias("s"))
        parts = part if parts is None else parts.unionAll(part)
    total = F.sum("s") if decimals is None else F.round(F.sum("s"), decimals)
    return ranked(parts.groupBy("query_id", "doc_id").agg(total.alias("score")), [F.col("score"), F.col("doc_id")], k)


def half_life_weight(age: Column, half_life: float) -> Column:
    """1, halved for each ``half_life`` of age."""
    return F.pow(F.lit(0.5), age / F.lit(half_life))


def recency(scored: DataFrame, age: Column, half_life: float, k: int, decimals: int | None = None) -> DataFrame:
    """Scores (higher is better) halved for each ``half_life`` of age."""
    s = F.col("score") * half_life_weight(age, half_life)
    return ranked(scored.withColumn("score", s if decimals is None else F.round(s, decimals)), [F.desc("score"), F.col("doc_id")], k)


def prefilter(docs: DataFrame, years: tuple[int | None, int | None] | None = None, **allowed: list) -> DataFrame:
    """The documents to rank: of the years from and to (null is open), and with allowed values of columns.

    The conditions reach the scan; a null in a filtered column is not allowed.
    """
    low, high = years or (None, None)
    if low is not None:
        docs = docs.where(F.col("year") >= low)
    if high is not None:
        docs = docs.where(F.col("year") <= high)
    for column, values in allowed.items():
        docs = docs.where(F.col(column).isin(list(values)))
    return docs


def weigh_sections(scored: DataFrame, weights: dict[str, float], k: int, default: float = 1.0) -> DataFrame:
    """Chunk scores (query_id, doc_id, section, score; higher is better) times their section's weight; a document's best counts."""
    weight = F.lit(default)
    for section, w in weights.items():
        weight = F.when(F.col("section") == section, F.lit(float(w))).otherwise(weight)
    best = scored.groupBy("query_id", "doc_id").agg(F.max(F.col("score") * weight).alias("score"))
    return ranked(best, [F.desc("score"), F.col("doc_id")], k)


def rerank(candidates: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Candidates ordered by a second-stage score (query_id, doc_id, score2); unscored last."""
    met = candidates.drop("rank").join(second, ["query_id", "doc_id"], "left")
    return ranked(met, [F.desc_nulls_last("score2"), F.desc("score"), F.col("doc_id")], k)


def abstain(queries: DataFrame, results: DataFrame, threshold: float, least: int = 2) -> DataFrame:
    """query_id, n_relevant and abstain: fewer than ``least`` scores over the threshold."""
    n = results.groupBy("query_id").agg(F.count_if(F.col("score") > threshold).alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_relevant"), (F.coalesce("n", F.lit(0)) < least).alias("abstain"))


def expand(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Queries with the aliases of their terms appended (aliases: term, alias)."""
    found = query_terms(queries).join(small(aliases), "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("more"))
    return queries.join(found, "query_id", "left").withColumn("query", F.concat_ws(" ", "query", "more")).drop("more")


def route(queries: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """query_id and source: that of the first rule (pattern, source) that matches."""
    chosen = F.lit(default)
    for pattern, source in reversed(rules):
        chosen = F.when(F.lower("query").rlike(pattern), source).otherwise(chosen)
    return queries.select("query_id", chosen.alias("source"))


def lexical_heads(terms: DataFrame, post: DataFrame, stats: tuple, k: int, decimals: int | None = None, name: str = "rank") -> DataFrame:
    """query_id, doc_id, score and place of the first ``k`` by BM25.

    Packed postings are scored in NumPy where doc_id is a whole number; documents that share one, and others, from a join.
    """
    order, kept = [F.col("score"), F.col("doc_id")], packed.packed_of(post)
    if kept is None or not _whole(post, "doc_id"):
        return ranked(bm25_of_postings(terms, post, stats, decimals), order, k, name)
    weights = term_weights(terms, post, stats)
    scored = packed.heads(kept, weights, k, (K1, B, stats[1] or 1.0), decimals)
    if kept.rest is not None:
        scored = scored.unionAll(bm25_of_postings(terms, kept.rest, stats, decimals, weights=weights))
    return ranked(scored, order, k, name)


def head_rankings(queries: DataFrame, vectors: DataFrame, post: DataFrame, stats: tuple, k: int, decimals: int | None = None) -> DataFrame:
    """query_id, doc_id, dense_rank and lexical_rank of the first ``k`` of either arm; a scratch table.

    All readouts of an evaluation up to depth k start from these ranks, so they
    are made once; ``post`` and ``stats`` come from :func:`cut_postings`.
    """
    d = dense_topk(queries, vectors, k, decimals).select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    x = lexical_heads(query_terms(queries), post, stats, k, decimals, "lexical_rank")
    return materialize(d.join(x.select("query_id", "doc_id", "lexical_rank"), ["query_id", "doc_id"], "full_outer"), "rankings")


def best_dense_ranks(queries: DataFrame, vectors: DataFrame, gold: DataFrame, name: str, decimals: int | None = None) -> DataFrame:
    """:func:`best_ranks` by cosine: gold pairs are scored, then the vectors up to the best one of a query are counted."""
    if not _whole(vectors, "doc_id"):
        scored = dense_scores(queries, vectors, decimals).withColumn("score", -F.col("score"))
        return best_ranks(scored, gold, name)
    q = queries.select("query_id", "vector")
    pairs = gold.select("query_id", "doc_id").distinct().join(vectors.select("doc_id", "vector"), "doc_id").join(q.withColumnRenamed("vector", "qv"), "query_id")
    sim = F.try_divide(dot(F.col("qv"), F.col("vector")), norm(F.col("qv")) * norm(F.col("vector")))
    scored = pairs.select("query_id", "doc_id", (sim if decimals is None else F.round(sim, decimals)).alias("score")).where("score is not null")
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("score"), "doc_id")).alias("g"))
    marks = materialize(best.select("query_id", (-F.col("g.score")).alias("score"), "g.doc_id"), "marks")
    return nearest.up_to(marks.join(q, "query_id"), vectors, decimals).select("query_id", F.col("n").cast("int").alias(name))


def best_lexical_ranks(terms: DataFrame, post: DataFrame, stats: tuple, gold: DataFrame, name: str, decimals: int | None = None) -> DataFrame:
    """:func:`best_ranks` by BM25: gold pairs are scored on their own, so that no pair is shuffled."""
    own = bm25_of_postings(terms, post, stats, decimals, gold)
    return best_ranks(bm25_of_postings(terms, post, stats, decimals), own, name)


def best_ranks(scored: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """query_id and the best rank of its gold, at any depth, by ascending score and doc_id.

    Nothing is sorted: the rows up to the best gold row of a query are counted,
    with map-side combine. Queries whose gold is not scored are left out. Gold that
    has its scores saves a join with ``scored``.
    """
    own = gold if "score" in gold.columns else scored.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    best = materialize(own.groupBy("query_id").agg(F.min(F.struct("score", "doc_id")).alias("g")), "best")
    up_to = (F.col("doc_id") == F.col("g.doc_id")) | (F.col("score") < F.col("g.score")) | (F.col("score") == F.col("g.score")) & (F.col("doc_id") <= F.col("g.doc_id"))
    return scored.join(small(best), "query_id").where(up_to).groupBy("query_id").agg(F.count("*").cast("int").alias(name))
