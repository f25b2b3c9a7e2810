"""Matrix products against a join of all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import nearest, ranking


def _sets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (400, 6)))]  # few directions, many ties
    rows += [(None, [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (7, [1.0] * 6), (901, None), (902, [1.0, 2.0]), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [math.nan] + [1.0] * 5), (905, [0.0] * 6), (-3, [2.0, 0.0, 2.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(3)
    q = v.where("doc_id % 20 = 7 or doc_id > 900").select(F.col("doc_id").alias("query_id"), "vector")
    return q, v


def _rows(df):
    return sorted(map(str, df.select("query_id", "doc_id", "score", "rank").collect()))


def test_heads_are_those_of_all_pairs(spark, monkeypatch):
    q, v = _sets(spark)
    order = [F.desc("score"), F.col("doc_id")]
    weight = F.when(F.col("doc_id") != 11, 1 / (1 + F.abs(F.col("doc_id")) % 7))
    for block in (4096, 5):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
        for decimals in (None, 9, 2):
            scored = ranking.dense_scores(q, v, decimals)
            assert _rows(ranking.dense_topk(q, v, 4, decimals)) == _rows(ranking.ranked(scored, order, 4))
        assert _rows(ranking.dense_topk(q, v, 4, 9, others=True)) == _rows(ranking.ranked(ranking.dense_scores(q, v, 9).where("query_id <> doc_id"), order, 4))
    weighed = ranking.dense_scores(q, v, 9).withColumn("score", F.round(F.col("score") * weight, 9))
    assert _rows(ranking.dense_topk(q, v, 500, 9, weight)) == _rows(ranking.ranked(weighed, order, 500))
    assert ranking.dense_topk(q.where("query_id < -9"), v, 4).count() == 0
    named = v.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert ranking.dense_topk(q, named, 2, 9).count() == ranking.dense_topk(q, v, 2, 9).count()


def test_no_pair_is_joined(spark):
    q, v = _sets(spark)
    plan = ranking.dense_topk(q, v, 4, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_best_dense_ranks_count_like_a_sort(spark):
    q, v = _sets(spark)
    q, v = q.where("query_id < 900"), v.where("doc_id is null or doc_id <> 904")
    gold = q.select("query_id", F.explode(F.array(F.col("query_id") + 3, F.lit(50), F.lit(901), F.lit(7))).alias("doc_id"))
    scored = ranking.dense_scores(q, v, 9).withColumn("score", -F.col("score"))
    want = {r.query_id: r.n for r in ranking.best_ranks(scored, gold, "n").collect()}
    assert len(want) > 5 and {r.query_id: r.n for r in ranking.best_dense_ranks(q, v, gold, "n", 9).collect()} == want


def test_half_up_is_sparks(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.random(2000) - 0.5, rng.integers(-(10**6), 10**6, 2000) / 10**5 / 2, [0.0, -0.0, 2.5, -1e-12, 1e300, np.nan, np.inf]))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for d in (2, 5, 9):
        want = [r.r for r in df.select(F.round("x", d).alias("r")).collect()]
        assert np.array_equal(nearest.half_up(x, d), np.array(want), equal_nan=True)


def test_lexical_pairs_are_cut_before_the_shuffle(spark, monkeypatch):
    """No pair of a query and a document crosses a shuffle: only postings do, and each task's heads."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 12, 9))) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i % 12} w{i % 5} w7") for i in range(30)], "query_id long, query string")
    whole = {tuple(r) for r in ranking.lexical_topk(queries, docs, 5, decimals=9).collect()}
    monkeypatch.setattr(ranking, "PAIRS", 500)
    top = ranking.lexical_topk(queries, docs, 5, decimals=9)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in top.collect()} == whole
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("query_id" in x and "doc_id" in x for x in exchanges) and any("REPARTITION_BY_NUM" in x for x in exchanges)
    terms, (post, stats) = ranking.query_terms(queries), ranking.cut_postings(ranking.query_terms(queries), docs)
    gold = queries.select("query_id", (F.col("query_id") * 3).alias("doc_id"))
    want = ranking.best_ranks(ranking.bm25_of_postings(terms, post, stats, 9), gold, "n")
    assert sorted(ranking.best_lexical_ranks(terms, post, stats, gold, "n", 9).collect()) == sorted(want.collect())


def test_packed_heads_are_those_of_joined_postings(spark, monkeypatch):
    """Against the join of all pairs: folded and odd words, repeated and null doc_ids, ties, small blocks and steps."""
    rng = np.random.default_rng(9)
    words = ["naïve", "été", "Σίσυφος", "x1", "über", "zażółć", "İz", "naive", "the", "²half", "中文"]
    rows = [(i, "  ".join(words[x] for x in rng.integers(0, 11, 1 + i % 17)) + ("." if i % 2 else "")) for i in range(150)]
    rows += [(7, "naive the"), (7, "the the été"), (8, rows[8][1]), (None, "the été"), (None, "x1"), (500, None), (501, ""), (502, " ... "), (503, "the été")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, f"naive the ete ete {'x1 uber zazolc' if i % 2 else 'half iz'}") for i in range(9)] + [(50, "nowhere"), (51, None)], "query_id long, query string")
    terms = ranking.query_terms(queries)
    packed, stats = ranking.cut_postings(terms, docs)
    joined, known = ranking._joined_postings(terms, docs, "text")
    columns = ["doc_id", "len", "term", "tf"]
    assert stats == known and sorted(map(str, packed.select(columns).collect())) == sorted(map(str, joined.select(columns).collect()))
    assert sorted(ranking.document_frequency(packed).collect()) == sorted(ranking.document_frequency(joined).collect())
    want = ranking.ranked(ranking.bm25_of_postings(terms, joined, known, 9), [F.col("score"), F.col("doc_id")], 12)
    for block, step in ((4096, 1 << 20), (2, 40)):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
        monkeypatch.setattr(ranking.packed, "BLOCK_ROWS", block)
        monkeypatch.setattr(ranking.packed, "PAIRS", step)
        got = ranking.lexical_heads(terms, packed, stats, 12, 9)
        assert _rows(got) == _rows(want.select(got.columns)) and got.count() > 100
    assert ranking.lexical_heads(terms.where("query_id = 50"), packed, stats, 5, 9).count() == 0
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 2)
    assert sorted(map(str, ranking.cut_postings(terms, docs)[0].select(columns).collect())) == sorted(map(str, joined.select(columns).collect()))


def test_pool_ci_shuffles_no_posting_and_no_text(spark, tmp_path):
    """Postings of whole documents are read as they were written, and texts stay where they are read to find the gold."""
    from corvane.plans import retrieval

    docs = [(i, f"alpha beta gamma w{i % 7} delta epsilon") for i in range(60)] + [(3, "so alpha beta gamma w4 delta it is, in a longer text")]
    items = [(i, f"beta gamma w{i} delta") for i in range(7)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(60)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    post, stats = retrieval.corpus_of(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the texts were many
    try:
        gold = retrieval.gold_of(spark, str(tmp_path), post)
        found = sorted(map(tuple, gold.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == sorted((i, j) for i, x in items for j, t in docs if x in t)
    terms = ranking.query_terms(retrieval.items_of(spark, str(tmp_path)))
    assert ranking.lexical_heads(terms, post, stats, 5, 9).count() == 35
    heads = ranking.lexical_heads(terms, *ranking.cut_postings(terms, spark.createDataFrame(docs[:60], "doc_id long, text string")), 5, 9)
    assert heads.count() == 35
    for made in (gold, heads):
        assert "Exchange hashpartitioning(doc_id" not in made._jdf.queryExecution().executedPlan().toString()
