"""Operators against worked examples."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import contract, curate, ingest, ireval, ranking, stats
from corvane.sources import readers, writers
from corvane.sources.schemas import GOLD, PAPER

PAPERS = [
    ("2023A&A...100..001A", "Alpha", 2023, ["X"], "First abstract."),
    ("2022ApJ...900..002B", "Beta", 2022, [], "Second abstract."),
    ("2021MNRAS.500..003C", "Gamma", 2021, [], "Third abstract."),
]
IDS = [p[0] for p in PAPERS]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_indexed_text(spark):
    rows = [("Only title", None), (None, "Only abstract."), (None, None), (" A. ", " b c. "), ("", "")]
    df = spark.createDataFrame(rows, "t string, a string").select(T.indexed_text(F.col("t"), F.col("a")).alias("x"))
    assert [r.x for r in df.collect()] == ["Only title", "Only abstract", "", "A.. b c", ""]


def test_tokens_and_keys(spark):
    df = spark.createDataFrame([("Čech naïve WASP-39b", "q?"), (None, " q? ")], "a string, q string")
    rows = df.select(T.query_tokens(F.col("a")).alias("q"), T.document_tokens(F.col("a")).alias("d"), T.whitespace_tokens(F.col("a")).alias("n"), T.query_slug(F.col("q")).alias("s")).collect()
    assert rows[0].q == ["ech", "na", "ve", "wasp", "39b"] and rows[0].d == ["cech", "naive", "wasp", "39b"]
    assert rows[0].n == 3 and rows[1].n == 0 and rows[1].q == [] and {r.s for r in rows} == {"6a02e222"}
    assert T.config_fingerprint({"arm": "hybrid", "k": 100, "pool": 100}) == "c289e7e0"
    assert T.run_id({"arm": "hybrid", "k": 100, "pool": 100}, "sha256:abcdef0123456789", "20260721T120000Z") == "rrf-pool100-abcdef01-c289e7e0-20260721T120000Z"
    assert T.connection_label("postgresql://u:p@db:5433/x") == "db:5433/x"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalise(F.col("a")).alias("n")).collect()
    assert rows[0].c == pytest.approx(1) and rows[1].c is None and rows[0].n == pytest.approx([0.6, 0.8]) and rows[1].n == [0, 0]
    with pytest.raises(Exception, match="expected 3"):
        df.select(V.assert_dimension(F.col("a"), 3)).collect()


def test_bm25_edges(spark):
    texts = ["the cat sat on the mat", "dog and cat and cat", "Čech naïve café results", "a dog ran far away from the cat today", "wasp 39b spectrum of WASP-39b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {
        "cat": {1: -1.442623e-06, 0: -1.0e-06, 3: -8.301887e-07},
        "dog cat": {1: -0.361094, 3: -0.279336, 0: -1.0e-06},
        "cat cat": {1: -2.885246e-06, 0: -2.0e-06, 3: -1.660377e-06},
        "wasp 39b": {4: -3.021184},
        "cafe": {2: -1.272077},
        "naive Čech": {2: -1.272077},
        "": {},
    }
    q = spark.createDataFrame(list(enumerate(wanted)), "query_id long, query string")
    got = {}
    for r in ranking.lexical_topk(q, docs, 10).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = (r.score, r.rank)
    for i, want in enumerate(wanted.values()):
        found = got.get(i, {})
        assert {d: s for d, (s, _) in found.items()} == pytest.approx(want, rel=1e-5)
        assert [d for d, _ in sorted(found.items(), key=lambda x: x[1][1])] == sorted(want, key=want.get)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "gamma beta")], "query_id long, query string")
    ranking.build_index(docs, str(tmp_path / "i"))
    with pytest.raises(Exception, match="already exists|EXISTS"):
        ranking.build_index(docs, str(tmp_path / "i"))
    a, b = (sorted((r.doc_id, round(r.score, 9), r["rank"]) for r in x.collect()) for x in (ranking.search_index(q, str(tmp_path / "i"), 5), ranking.lexical_topk(q, docs, 5)))
    assert a == b and len(a) == 2


def test_rrf_ties(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, doc_id string, rank int")
    x = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "d", 3)], "query_id long, doc_id string, rank int")
    rows = ranking.fuse(d, x).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == list("abcd")
    assert [round(r.score, 6) for r in rows] == [0.032522, 0.032522, 0.015873, 0.015873]


def test_retrieve_arms(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish"), (3, "bird")], "doc_id long, text string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(7, "red fish", [1.0, 0.1])], "query_id long, query string, vector array<double>")
    for arm in ("dense", "lexical", "hybrid"):
        assert ranking.retrieve(q, docs, vec, arm, 2).orderBy("rank").first().doc_id == 1
    assert "rrf_score" in ranking.hybrid_search(q, docs, vec, 2).columns
    with pytest.raises(ValueError, match="unknown arm"):
        ranking.retrieve(q, docs, vec, "magic")


def test_evaluation(spark):
    ranks = spark.createDataFrame([(1, "a", 1, None, 1), (1, "b", None, 3, 2), (2, "c", 12, 12, 12)], "query_id long, doc_id string, dense_rank int, lexical_rank int, hybrid_rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z"), (2, "c")], "query_id long, doc_id string")
    rows = {r.query_id: r for r in ireval.per_query(ireval.gold_ranks(gold, ranks), 10).collect()}
    assert rows[1].dense_recall == pytest.approx(1 / 3) and rows[1].lexical_rr == pytest.approx(1 / 3) and rows[1].union_recall == pytest.approx(2 / 3)
    assert (rows[1].dense_only, rows[1].lexical_only, rows[1].both, rows[1].neither) == (1, 1, 0, 1)
    assert rows[2].hybrid_recall == 0 and rows[2].hybrid_rr == 0 and rows[2].union_recall == 1
    bad = ireval.frozen_gate(spark.createDataFrame([("x", 0.5)], "k string, v double"), spark.createDataFrame([("x", 0.5004), ("y", 1.0)], "k string, v double"), ["k"], "v")
    assert [r.k for r in bad.collect()] == ["y"]


def test_bootstrap(spark):
    n, mean, lo, hi = stats.stream_intervals([np.array([1, 0, 0.5, 1, 0])])[0]
    assert (n, mean, lo, hi) == pytest.approx((5, 0.5, 0.1, 0.9))
    assert stats.stream_intervals([np.array([])], seed=1).tolist() == [[0, 0, 0, 0]]
    v = spark.createDataFrame([(i, "g", 2.0) for i in range(5)], "id long, slice string, value double")
    r = one(stats.bootstrap(v, ["slice"], 50))
    assert (r.n, r.mean, r.lo, r.hi) == (5, 2.0, 2.0, 2.0)
    loo = one(stats.stability(stats.leave_one_out(v, 20)))
    assert (loo.n, loo.surviving, loo.hinges) == (5, 5, "")


def test_bootstrap_grids(spark, monkeypatch):
    """Intervals of several groups against plain loops over the same stream, and in blocks."""
    rng = np.random.default_rng(3)
    data = {("x", "a"): rng.random(7), ("x", "b"): rng.random(12) - 0.5, ("y", "a"): np.array([])}
    rows = [(*g, i, float(v)) for g, vs in data.items() for i, v in reversed(list(enumerate(vs)))]
    values = spark.createDataFrame(rows, "arm string, slice string, id long, value double")

    def plain(vs, generator, b=300):
        if not len(vs):
            return 0, 0.0, 0.0, 0.0
        means = [np.mean([vs[i] for i in row]) for row in generator.integers(0, len(vs), size=(b, len(vs)))]
        return len(vs), vs.mean(), np.percentile(means, 2.5), np.percentile(means, 97.5)

    order = [*data, ("x", "a")]
    for block in (1 << 22, 40):
        monkeypatch.setattr(stats, "BLOCK", block)
        one_stream = np.random.default_rng(9)
        want = [plain(data[g], one_stream) for g in order]
        got = stats.numpy_grid(values, order, ["arm", "slice"], 300, 9).collect()
        assert [(r.arm, r.slice) for r in got] == order and np.allclose([(r.n, r.mean, r.lo, r.hi) for r in got], want)
        fresh = stats.numpy_grid(values, order, ["arm", "slice"], 300, 9, fresh=True).collect()
        assert np.allclose([(r.n, r.mean, r.lo, r.hi) for r in fresh], [plain(data[g], np.random.default_rng(9)) for g in order])
    r = stats.numpy_paired(values, [("x", "b")], ["arm", "slice"], 300, 9).first()
    v = data["x", "b"]
    clear = lambda ci: not ci[2] <= 0 <= ci[3]
    alone = [clear(plain(np.delete(v, i), np.random.default_rng(9))) for i in range(12)]
    assert (r.excludes_zero, r.loo_surviving, r.loo_total) == (clear(plain(v, np.random.default_rng(9))), sum(alone), 12)
    assert r.hinges == ",".join(str(i) for i in range(12) if not alone[i])


def test_bootstrap_joined(spark, monkeypatch):
    """Values that are too many to broadcast give the same intervals."""
    rows = [("a", i, float(i % 3)) for i in range(9)] + [("b", i, float(i)) for i in range(4)]
    values = spark.createDataFrame(rows, "g string, id long, value double")
    show = lambda: sorted((r.g, r.n, round(r.mean, 9), round(r.lo, 9), round(r.hi, 9)) for r in stats.bootstrap(values, ["g"], 40).collect())
    want = show()
    monkeypatch.setattr(stats, "BROADCAST_VALUES", 5)
    assert show() == want
    with pytest.raises(ValueError, match="leave-one-out"):
        stats.leave_one_out(values)


def test_co_citation_least(spark):
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "b"), (3, "c"), (3, None), (3, "d")], "source int, target string")
    all_ = {(r.a, r.b): r.n for r in curate.co_citation(edges).collect()}
    assert all_ == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "d"): 1}
    assert {(r.a, r.b): r.n for r in curate.co_citation(edges, least=2).collect()} == {("a", "b"): 2}


def test_jdbc(spark):
    """A database in the driver's JVM, read whole and in ranges of a key."""
    url = "jdbc:derby:memory:corvane;create=true"
    spark.range(50).selectExpr("id as K", "id * 2 as V").write.format("jdbc").option("url", url).option("dbtable", "T").mode("overwrite").save()
    whole = readers.read_jdbc(spark, url, "select K, V from T where K < 30")
    assert sorted((r.K, r.V) for r in whole.collect()) == [(i, 2 * i) for i in range(30)]
    parts = readers.read_jdbc(spark, url, "select K, V from T", "K", (0, 50), 4)
    assert parts.rdd.getNumPartitions() == 4 and sorted(r.K for r in parts.collect()) == list(range(50))


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"\\emph{x}")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in readers.whole_files(spark, str(tmp_path), "*.tex").collect()] == [("a.tex", b"\\emph{x}")]


def test_leave_one_out_against_each_subset(spark):
    rows = [(i * 3, float(np.sin(i))) for i in range(9)]
    got = {r.left_out: r for r in stats.leave_one_out(spark.createDataFrame(rows, "id long, value double"), 60).collect()}
    for i, _ in rows:
        rest = spark.createDataFrame([("g", j, v) for j, v in rows if j != i], "g string, id long, value double")
        r = one(stats.bootstrap(rest, ["g"], 60))
        assert (got[i].n, got[i].mean, got[i].lo, got[i].hi) == pytest.approx((r.n, r.mean, r.lo, r.hi))
    assert stats.leave_one_out(spark.createDataFrame(rows[:1], "id long, value double"), 5).count() == 0


def test_best_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(q, d, float(rng.integers(0, 6))) for q in range(4) for d in range(30)]
    gold = [(0, 3), (0, 9), (1, 29), (2, 99), (3, 0), (3, 0), (7, 1)]
    scored = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    got = {r.query_id: r.best for r in ranking.best_ranks(scored, spark.createDataFrame(gold, "query_id long, doc_id long"), "best").collect()}
    want = {}
    for q in range(4):
        order = [d for _, d in sorted((s, d) for p, d, s in rows if p == q)]
        places = [order.index(d) + 1 for p, d in gold if p == q and d in order]
        want |= {q: min(places)} if places else {}
    assert got == want


def test_gold_is_found_by_inner_words(spark, tmp_path):
    """Against ``in``: items that begin or end amid words, of one word, with odd white space, and nulls."""
    from corvane.plans import retrieval

    docs = ["xalpha beta gamma deltax", "alpha  beta gamma", "Alpha beta gamma delta", "one", "zone two", None, "", "alpha beta gamma delta epsilon", "two", "beta gamma"]
    items = ["alpha beta gamma delta", "one", "e two", "beta gamma", "alpha  beta gamma", "no such words here", None, "Alpha beta gamma"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    post, _ = retrieval.corpus_of(spark, str(tmp_path))
    got = sorted((r.query_id, r.doc_id) for r in retrieval.gold_of(spark, str(tmp_path), post).collect())
    assert got == sorted((i, j) for i, x in enumerate(items) for j, d in enumerate(docs) if x is not None and d is not None and x in d)


def test_merge_and_guards(spark, tmp_path):
    base = spark.createDataFrame(PAPERS[:2], PAPER)
    new = spark.createDataFrame([("2022ApJ...900..002B", "Other", 1, [], "x"), PAPERS[2]], PAPER)
    merged = {r.bibcode: r.title for r in ingest.merge_keep_first(base, new).collect()}
    assert merged == {IDS[0]: "Alpha", IDS[1]: "Beta", IDS[2]: "Gamma"}
    r = one(ingest.merge_report(base, new))
    assert (r.n_base, r.n_fetched, r.n_overlap, r.n_merged, r.superset) == (2, 2, 1, 3, True)
    with pytest.raises(ValueError, match="frozen"):
        ingest.guard_output("/a/b/", "/a/b")
    f = tmp_path / "c.jsonl"
    f.write_text("\n".join(json.dumps({"bibcode": b, "title": "t", "abstract": "a"}) for b in ("x", "y")) + "\n\n")
    assert readers.load_snapshot(spark, str(f)).count() == 2
    f.write_text('{"bibcode": "x"}\n{"bibcode": "x"}\n')
    with pytest.raises(ValueError, match="more than once"):
        readers.load_snapshot(spark, str(f))
    f.write_text('{"title": "x"}\n')
    with pytest.raises(ValueError, match="no bibcode"):
        readers.load_snapshot(spark, str(f))
    f.write_text("")
    with pytest.raises(ValueError, match="empty"):
        readers.load_snapshot(spark, str(f))


def test_content_hash(spark):
    papers = spark.createDataFrame([("b", "x", None), ("a", "y", None)], "bibcode string, title string, abstract string")
    assert ingest.content_hash(papers) == "sha256:111ac78016fd3217ac961274530dd3ed3a444bbabffffa88a1a678fe5cf69bd1"
    tree = one(ingest.content_hash_tree(papers)).corpus_hash
    assert tree == one(ingest.content_hash_tree(papers.orderBy("bibcode"))).corpus_hash != one(ingest.content_hash_tree(papers.withColumn("title", F.lit("z")))).corpus_hash
    assert one(ingest.content_hash_tree(papers.limit(0))).corpus_hash is not None


def test_search_and_normalise(spark):
    raw = spark.createDataFrame([("a", ["T", "u"], "2020", None, "abs", 5), ("a", ["T"], "2020", None, "abs", 3), ("", ["x"], "2021", None, "y", 1), ("b", [], "bad", ["n"], "z", 9), ("c", None, "2019", None, "", 1)], "bibcode string, title array<string>, year string, author array<string>, abstract string, citation_count long")
    rows = {r.bibcode: r for r in ingest.normalise(raw).collect()}
    assert rows["b"].title == "" and rows["b"].year is None and rows["a"].authors == [] and set(rows) == {"a", "b"}
    assert [r.citation_count for r in ingest.search(raw, 2020, 1, "AB").collect()] == [5]


def example(**change):
    row = {
        "example_id": "lit_qa-eval-deadbeef", "task_family": "lit_qa", "partition": "eval", "query": "q?", "retrieved_context": [(IDS[0], "c", 1.0), (IDS[1], "c", 0.5)], "answer": "An answer.",
        "claims": [("t", IDS[0], "span", True)], "abstention_reason": None, "is_negative": False, "negative_type": None, "provenance": {"corpus_hash": "h"},
    }
    return tuple((row | change).values())


NEGATIVE = {"partition": "calibration", "is_negative": True, "negative_type": "claim_not_supported", "claims": [("t", IDS[0], "s", False)]}
ABSTAIN = {"task_family": "abstention", "abstention_reason": "absent", "claims": [("t", None, None, True)]}
CASES = [
    ({}, None), (NEGATIVE, None), (ABSTAIN, None),
    ({"answer": "   "}, "answer must not be empty"), ({"claims": [(" ", IDS[0], "s", True)]}, "text must not be empty"), ({"claims": []}, "must cite a bibcode"),
    ({"claims": [("t", None, "s", True)]}, "must cite a bibcode"), (ABSTAIN | {"abstention_reason": None}, "requires abstention_reason"), ({"abstention_reason": "thin"}, "only valid for the abstention"),
    (NEGATIVE | {"partition": "eval"}, "calibration partition"), (NEGATIVE | {"negative_type": None}, "requires a negative_type"), (NEGATIVE | {"claims": [("t", IDS[0], "s", True)]}, "at least one claim with supported=False"),
    ({"negative_type": "contradicts"}, "only valid when is_negative"), ({"claims": [("t", IDS[0], "s", False)]}, "all claims supported"), (ABSTAIN | {"is_negative": True}, "calibration partition"),
    ({"task_family": "not_a_family"}, "task_family"), ({"query": None}, "query"), ({"answer": None}, "answer"), ({"example_id": None}, "example_id"),
]


def test_contract_rules(spark):
    rows = [(i, *example(**c)) for i, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i int, {GOLD}").select("i", contract.rule_message().alias("m"))
    for r in df.collect():
        want = CASES[r.i][1]
        assert (r.m is None) if want is None else want in (r.m or ""), (CASES[r.i], r.m)


def test_contract_corpus(spark):
    corpus = spark.createDataFrame(PAPERS, PAPER)
    unknown, outside = "2099ZZZZ.999..999Z", IDS[2]
    cases = {
        "a": ({"retrieved_context": [(unknown, "c", 1.0), (IDS[0], "c", 1.0)]}, [("error", "absent from corpus snapshot")]),
        "b": ({"claims": [("t", unknown, "s", True)]}, [("error", "absent from corpus")]),
        "c": ({"claims": [("t", outside, "s", True)]}, [("error", "not in this query's retrieved_context")]),
        "d": (NEGATIVE | {"negative_type": "wrong_paper", "claims": [("t", outside, "s", False)]}, [("warning", "not in this query's")]),
        "e": ({"claims": [("t", IDS[0], None, True)]}, [("warning", "no support_span")]),
        "f": ({}, []),
    }
    gold = spark.createDataFrame([example(**(c | {"example_id": k})) for k, (c, _) in cases.items()], GOLD)
    got = {}
    for r in contract.findings(gold, corpus).collect():
        got.setdefault(r.example_id, []).append((r.level, r.message))
    for k, (_, want) in cases.items():
        assert len(got.get(k, [])) == len(want) and all(lv == gl and m in gm for (lv, m), (gl, gm) in zip(want, got.get(k, []))), (k, got.get(k))
    assert contract.findings(gold).count() == 0


def test_accounting_and_manifest(spark, tmp_path):
    gold = spark.createDataFrame([example(), example(**ABSTAIN), example(**NEGATIVE)], GOLD)
    counts = {(r.dimension, r.value): r.n for r in contract.composition(gold).collect()}
    assert counts["total", "all"] == 3 and counts["partition", "calibration"] == 1 and counts["task_family", "lit_qa"] == 2 and counts["task_family", "summarization"] == 0
    many = spark.createDataFrame([example(**NEGATIVE)] * 61, GOLD)
    status = {r.group: r.status for r in contract.target_progress(contract.composition(many)).collect()}
    assert status["calibration/negative"] == "over" and status["total"] == "under"
    assert [r.query for r in contract.disjointness(gold).collect()] == ["q?"]
    assert one(contract.hash_consistency(gold, "other")).mismatched == "h"
    m = contract.manifest(gold, spark.createDataFrame(PAPERS, PAPER), "h", {"k": 1})
    data = writers.write_manifest(m, str(tmp_path / "m.json"))
    assert data["valid"] is False and data["disjoint"] is False and json.loads((tmp_path / "m.json").read_text())["counts"]


def test_manifest_counts_all_shared_queries(spark):
    rows = [example(query=f"q{i}", partition=p) for i in range(101) for p in ("calibration", "eval")]
    m = one(contract.manifest(spark.createDataFrame(rows, GOLD), spark.createDataFrame(PAPERS, PAPER), "h", {"k": 1}))
    assert m.n_shared_queries == 101 and len(m.shared_queries) == 100 and not m.disjoint and not m.valid


def test_gold_files(spark, tmp_path):
    rows, errors = readers.load_gold(spark, str(tmp_path / "none.jsonl"))
    assert rows.count() == errors.count() == 0
    f = tmp_path / "g.jsonl"
    good = json.dumps({"example_id": "a", "task_family": "lit_qa", "partition": "eval", "query": "q", "answer": " "})
    f.write_text(good + "\n{bad\n\n" + good + "\n")
    rows, errors = readers.load_gold(spark, str(f))
    assert sorted(r.line_no for r in rows.collect()) == [1, 4] and one(errors).message == "line 2: invalid JSON"
    df = spark.createDataFrame([example(example_id="x")], GOLD)
    assert writers.append_new(df, str(tmp_path / "out"), "example_id") == 1 and writers.append_new(df, str(tmp_path / "out"), "example_id") == 0


def test_query_sets(spark):
    text = "queries:\n- {id: q01, query: a, expected_bibcodes: [x, y]}\n- {id: q02, query: b, expected_bibcodes: []}\n"
    assert {r.query_id: r.gold for r in readers.query_set(spark, text).collect()} == {"q01": ["x", "y"], "q02": []}
    part = readers.partition_set(spark, "known_item: {q01: [x]}\nbroad_entity: {q02: [y]}\nunscored: [q03]\n")
    assert {r.query_id: r.slice for r in part.collect()} == {"q01": "known_item", "q02": "broad_entity", "q03": "unscored"}


def pages(start, rows):
    return [{"bibcode": f"b{i}"} for i in range(start, min(start + rows, 5))]


def test_paged_source(spark):
    import sys

    sys.modules.setdefault("paged_fixture", sys.modules[__name__])
    spark.sparkContext.addPyFile(__file__)
    df = readers.read_paged(spark, "test_core:pages", "bibcode string", limit=6, page=2)
    assert [r.bibcode for r in df.orderBy("seq").collect()] == ["b0", "b1", "b2", "b3", "b4"]


def test_chat_rules(spark):
    m = lambda *roles: [(r,) for r in roles]
    df = spark.createDataFrame([(1, m("user", "assistant")), (2, m("user")), (3, m("user", "robot")), (4, m("user", "user")), (5, None)], "id int, messages array<struct<role:string>>")
    assert {r.id: r.message.split(":")[1] for r in contract.chat_errors(df).collect()} == {2: " at least 2", 3: " unknown role", 4: " no assistant turn", 5: " field required"}


def test_fuzzy_duplicates_against_brute_force(spark):
    """Graded copies under smaller documents that share buckets, but are not alike enough."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(base[: 70 + 4 * i] + [f"x{i}n{j}" for j in range(45 - 4 * i)]) for i in range(4)}
    for i in range(4, 44):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            words[at] = f"y{i}"
        texts[i] = " ".join(words[: 120 - (i % 5) * 2])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = {r.doc_id: set(r.sh) for r in curate.shingle_hashes(docs, 5).collect()}
    buckets = {}
    for r in curate.minhash_bands(docs).collect():
        buckets.setdefault((r.band, r.key), []).append(r.doc_id)
    want = {}
    for members in buckets.values():
        for x in members:
            for y in members:
                alike = len(held[x] & held[y]) / len(held[x] | held[y])
                if y < x and alike >= 0.8 and y < want.get(x, (x,))[0]:
                    want[x] = (y, round(alike, 9))
    got = {r.doc_id: (r.keeper, round(r.jaccard, 9)) for r in curate.fuzzy_duplicates(docs).collect()}
    assert len(want) > 20 and got == want
    assert {r.doc_id: (r.keeper, round(r.jaccard, 9)) for r in curate.fuzzy_duplicates(docs, rounds=1).collect()} == want


def test_fuzzy_duplicates_ship_sets_not_pairs(spark, monkeypatch):
    """Families of variants, copies, short, empty and repeated rows: brute force over buckets, with buckets in parts and several passes."""
    rng = np.random.default_rng(5)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(90)]
        for i in range(40):
            words = list(base)
            for at in rng.choice(90, int(rng.integers(0, 4)), replace=False):
                words[at] = f"y{family}n{i}"
            rows.append((i * 3 + family, " ".join(words)))
    rows += [(200, rows[7][1]), (201, rows[7][1]), (5, rows[40][1]), (5, rows[7][1]), (9, rows[9][1]), (None, rows[3][1]), (300, "a b"), (301, "A, b!"), (302, ""), (303, None), (304, "B a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [(i, frozenset(r.sh)) for i, r in enumerate(curate.shingle_hashes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 5).collect())]
    keys = {}
    for r in curate.shingles.signatures(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), 5, 10, 3).collect():
        keys[r.doc_id] = set(enumerate(r["keys"]))
    want = {}
    for i, a in sets:
        for j, b in sets:
            x, y = rows[i][0], rows[j][0]
            if None in (x, y) or y >= x or not a or not b or not keys[i] & keys[j]:
                continue
            alike = len(a & b) / len(a | b)
            if alike >= 0.8 and (y, -alike) < want.get(x, (x, 0)):
                want[x] = (y, -alike)
    assert len(want) > 60 and 300 not in want and want[301] == (300, -1.0)
    for hashes, placed in ((1 << 23, 250_000), (700, 250_000), (1 << 23, 40)):
        monkeypatch.setattr(curate, "BUCKET_HASHES", hashes)
        monkeypatch.setattr(curate, "PLACED_ROWS", placed)
        got = {r.doc_id: (r.keeper, -r.jaccard) for r in curate.fuzzy_duplicates(docs).collect()}
        assert got == want


def test_curation(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog of the town"), (2, "der hund und die katze"), (3, ""), (4, None), (5, "the cat and the dog of the town")], "doc_id long, text string")
    assert {r.doc_id: r.guess for r in curate.guess_language(docs).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "en"}
    assert {(r.doc_id, r.keeper) for r in curate.exact_duplicates(docs).collect()} >= {(1, 1), (5, 1)}
    assert [(r.doc_id, r.keeper) for r in curate.fuzzy_duplicates(docs).collect()] == [(5, 1)]
    long = spark.createDataFrame([(1, " ".join(map(str, range(n)))) for n in (512,)] + [(2, " ".join(map(str, range(513)))), (3, " ".join(map(str, range(512 + 462)))), (4, "")], "doc_id long, text string")
    sizes = {}
    for r in curate.chunk_windows(long).orderBy("doc_id", "chunk_index").collect():
        sizes.setdefault(r.doc_id, []).append(r.n_tokens)
    assert sizes == {1: [512], 2: [512, 51], 3: [512, 512]}
    assert one(spark.range(1).select(curate.strip_markup(F.lit("<p>a&amp;b <script>x</script>\\emph{c}</p>")).alias("x"))).x == "a&b c"
    pts = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.5, 0.2), (3, 50.0, 80.0)], "id long, ra double, dec double")
    near = curate.nearest(curate.within_radius(pts, pts, 1.0).where("left_id <> right_id")).collect()
    assert {(r.left_id, r.right_id) for r in near} == {(1, 2), (2, 1)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert ranking.lexical_topk(q, docs, 5).count() == 0
    assert curate.fuzzy_duplicates(docs).count() == curate.chunk_windows(docs).count() == 0
    gold = spark.createDataFrame([], GOLD)
    assert contract.composition(gold).agg(F.sum("n")).first()[0] == 0 and one(contract.hash_consistency(gold, "h")).all_match


def test_authoring(spark, tmp_path):
    from corvane.plans import authoring

    corpus = spark.createDataFrame(PAPERS, PAPER)
    h = ingest.content_hash(corpus)
    assert h == "sha256:0dc09e39657f183ad1bb71eef1317aa96256e3eeb71fc1928131726011c645fa" or h.startswith("sha256:")
    sheet = authoring.worksheet("x-1", "q?", "lit_qa", "eval", [{"bibcode": IDS[0], "chunk_id": "c", "retrieval_score": 1.0}], h)
    gold = str(tmp_path / "gold")
    with pytest.raises(ValueError, match="answer must not be empty"):
        authoring.commit(spark, sheet, gold, corpus)
    sheet |= {"answer": "Yes.", "claims": [{"text": "t", "cited_bibcode": IDS[0], "support_span": "s", "supported": True}]}
    authoring.commit(spark, sheet, gold, corpus)
    with pytest.raises(ValueError, match="is in the gold file"):
        authoring.commit(spark, sheet, gold, corpus)
    with pytest.raises(ValueError, match="has changed"):
        authoring.commit(spark, sheet, gold, corpus.limit(1))
    with pytest.raises(ValueError, match="locked"):
        authoring.commit(spark, {"answer": "x"}, gold, corpus)
    with pytest.raises(ValueError, match="calibration"):
        authoring.check_flags("lit_qa", "eval", True, "wrong_paper")
    with pytest.raises(ValueError, match="differ"):
        authoring.guard_index(corpus, corpus.limit(2))
    assert authoring.build_manifest(spark, gold, corpus, str(tmp_path / "m.json")) is True
    q = spark.createDataFrame([(1, "first alpha", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    vec = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(IDS)], "doc_id string, vector array<double>")
    context = authoring.assemble_context(q, corpus, vec, h, "20260721T120000Z")
    assert context.orderBy("rank").first().bibcode == IDS[0] and context.count() == 3
    assert "First abstract." in one(authoring.render_context(context, corpus, 1)).text


def test_cli(spark, tmp_path, capsys):
    from corvane import cli

    raw = tmp_path / "raw.jsonl"
    raw.write_text("\n".join(json.dumps({"bibcode": b, "title": [t], "year": "2020", "abstract": a, "citation_count": i}) for i, (b, t, a) in enumerate((("b1", "Hot star", "A hot star."), ("b2", "Cold", "A cold planet.")))))
    assert cli.main(["ingest", "--raw", str(raw), "--output", str(tmp_path / "c")]) == 0
    assert cli.main(["index", "--input", str(tmp_path / "c"), "--output", str(tmp_path / "i")]) == 0
    assert cli.main(["retrieve", "cold planet", "--index", str(tmp_path / "i")]) == 0
    assert capsys.readouterr().out.startswith("b2\t-")
    (tmp_path / "q.yaml").write_text("- {id: q1, query: hot star, expected_bibcodes: [b1]}\n")
    assert cli.main(["evaluate", "--queries", str(tmp_path / "q.yaml"), "--index", str(tmp_path / "i")]) == 0
    assert "1.000" in capsys.readouterr().out
    spark.createDataFrame([("b1", [1.0, 0.0]), ("b2", [0.0, 1.0])], "doc_id string, vector array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([("q1", [0.1, 1.0]), ("q2", [0.0, 1.0])], "query_id string, vector array<double>").write.parquet(str(tmp_path / "qv"))
    index = ["--index", str(tmp_path / "i")]
    for arm, first in (("dense", "b2"), ("hybrid", "b1")):
        assert cli.main(["retrieve", "hot star", *index, "--arm", arm, "--vectors", str(tmp_path / "v"), "--query-vector", "[0.1, 1]" if arm == "dense" else "[1, 0.1]"]) == 0
        assert capsys.readouterr().out.startswith(first)
    (tmp_path / "q.yaml").write_text("- {id: q1, query: hot star, expected_bibcodes: [b1]}\n- {id: q2, query: cold planet, expected_bibcodes: [b2]}\n- {id: q30, query: nothing}\n")
    both = ["--queries", str(tmp_path / "q.yaml"), *index, "--vectors", str(tmp_path / "v"), "--query-vectors", str(tmp_path / "qv")]
    assert cli.main(["evaluate", *both, "--arm", "dense", "--k", "1"]) == 0
    out = capsys.readouterr().out
    assert "0.500" in out and "skipped: q30" in out
    assert cli.main(["ablate", *both, "--bootstrap", "50", "--json-out", str(tmp_path / "r.json")]) == 0
    data = json.loads((tmp_path / "r.json").read_text())
    assert data["config"]["n_scored"] == 2 and data["config"]["skipped"] == ["q30"] and len(data["bootstrap"]) == 36
    (tmp_path / "p.yaml").write_text("known_item: {q1: [b1]}\nbroad_entity: {q2: [b2]}\n")
    (tmp_path / "e.json").write_text('{"pool": 50, "slice": "all", "union_recall": 1.0}\n')
    run = ["sweep", *both, "--partition", str(tmp_path / "p.yaml"), "--pools", "50,100", "--bootstrap", "50"]
    assert cli.main([*run, "--expected", str(tmp_path / "e.json"), "--json-out", str(tmp_path / "s.json")]) == 0
    assert {r["pool"] for r in json.loads((tmp_path / "s.json").read_text())["pools"]} == {50, 100}
    (tmp_path / "e.json").write_text('{"pool": 50, "slice": "all", "union_recall": 0.5}\n')
    assert cli.main([*run, "--expected", str(tmp_path / "e.json"), "--json-out", str(tmp_path / "t.json")]) == 1 and not (tmp_path / "t.json").exists()
    (tmp_path / "p.yaml").write_text("known_item: {q1: [b2]}\nbroad_entity: {q2: [b2]}\n")
    assert cli.main(run) == 1
    (tmp_path / "p.yaml").write_text("known_item: {q1: [b1]}\n")
    assert cli.main(run) == 1
    capsys.readouterr()
    sheet, gold = tmp_path / "sheet.json", str(tmp_path / "gold")
    prepare = ["prepare", "--query", "hot star", "--query-vector", "[1, 0]", "--vectors", str(tmp_path / "v"), "--family", "lit_qa", "--partition", "eval", "--corpus", str(tmp_path / "c"), "--out", str(sheet)]
    assert cli.main([*prepare, "--dry-run"]) == 0 and not sheet.exists() and "A hot star." in capsys.readouterr().out
    assert cli.main([*prepare, "--negative"]) == 1 and cli.main(prepare) == 0 and cli.main(prepare) == 1
    commit = ["commit", "--sheet", str(sheet), "--gold", gold, "--corpus", str(tmp_path / "c")]
    assert cli.main(commit) == 1  # nothing is filled in
    data = json.loads(sheet.read_text())
    data |= {"answer": "Yes.", "claims": [{"text": "t", "cited_bibcode": "b1", "support_span": "s", "supported": True}]}
    sheet.write_text(json.dumps(data))
    assert cli.main(commit) == 0 and cli.main(commit) == 1 and spark.read.schema(GOLD).json(gold).count() == 1


def test_declared_refinements(spark, tmp_path):
    docs = spark.createDataFrame([(1, 2019, "a", "x"), (2, 2021, "b", "y"), (3, None, "a", "z")], "doc_id long, year int, source string, text string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(ranking.prefilter(docs, (2019, None))) == [1, 2] and ids(ranking.prefilter(docs, None, source=["a"])) == [1, 3] and ids(ranking.prefilter(docs)) == [1, 2, 3]
    scored = spark.createDataFrame([(1, 1, "title", 0.4), (1, 1, "body", 0.5), (1, 2, "body", 0.6), (1, 3, None, 0.1)], "query_id long, doc_id long, section string, score double")
    assert [r.doc_id for r in ranking.weigh_sections(scored, {"title": 2.0}, 2).orderBy("rank").collect()] == [1, 2]
    text = "# one\n" + " ".join(map(str, range(520))) + "\n# two\nshort"
    wins = curate.section_windows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("section_index", "chunk_index").collect()
    assert [(r.section_index, r.chunk_index, r.n_tokens) for r in wins] == [(0, 0, 512), (0, 1, 60), (1, 0, 3)]
    rows = curate.balance(spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "t string"), "t", {"a": 0.6, "b": 0.4, "c": 0.0}).collect()
    assert {(r.label, r.n, r.balanced) for r in rows} == {("a", 3, True), ("b", 1, False), (None, 1, False), ("c", 0, True)}
    r = one(ireval.refusals(spark.createDataFrame([(True, True), (True, False), (False, True)], "ok boolean, no boolean"), F.col("ok"), F.col("no")))
    assert (r.n, r.false_refusal_rate, r.within_cap) == (2, 0.5, False)
    corpus = spark.createDataFrame(PAPERS, PAPER)
    assert ingest.chunks_with_papers(ingest.chunks(corpus), corpus.limit(2)).count() == 2
    made = writers.write_package(spark.createDataFrame([(1, "train"), (2, "train"), (3, "eval")], "id long, split string"), str(tmp_path / "p"))
    assert [(x["split"], x["n"]) for x in made["splits"]] == [("eval", 1), ("train", 2)] and spark.read.json(str(tmp_path / "p")).count() == 3
    writers.write_eval_results(spark.createDataFrame([("m", "b", 0.5)], "model string, benchmark string, score double"), str(tmp_path / "e"))
    assert str(one(spark.read.parquet(str(tmp_path / "e"))).score) == "0.500"
    embed = V.embedder(lambda texts: [[len(t), 0] for t in texts], "p: ")
    assert [r.v for r in spark.createDataFrame([("ab",), (None,)], "t string").select(embed(F.col("t")).alias("v")).collect()] == [[1.0, 0.0], None]


def test_sky_cells_against_all_pairs(spark):
    """Poles, the wrap of right ascension, zone borders, wide radii and nulls."""
    rng = np.random.default_rng(2)
    sky = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(-400, 400, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))))]
    sky += [(300, 0.0, 90.0), (301, 180.0, 89.5), (302, 359.9, 10.0), (303, 0.1, 10.0), (304, 5.0, -90.0), (305, None, 1.0)]
    pts = spark.createDataFrame(sky, "id long, ra double, dec double")
    known = np.array([x[1:] for x in sky if x[1] is not None])
    a, d = np.radians(known[:, 0]), np.radians(known[:, 1])
    hav = np.sin((d[:, None] - d) / 2) ** 2 + np.cos(d[:, None]) * np.cos(d) * np.sin((a[:, None] - a) / 2) ** 2
    apart = np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(hav))))
    for radius in (0.7, 5.0, 40.0, 100.0):
        got = {(r.left_id, r.right_id) for r in curate.within_radius(pts, pts, radius).collect()}
        rows = curate.within_radius(pts, pts, radius).count()
        assert got == {(i, j) for i, j in zip(*np.nonzero(apart <= radius))} and rows == len(got)


def test_streaming_append(spark, tmp_path):
    from corvane.streaming import ingest as stream

    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").write.parquet(src)
    for _ in range(2):
        s = stream.file_stream(spark, src, "k string, v int")
        stream.append_once(s, "k", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_similar_sets_in_blocks_without_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = {i: sorted({f"g{x}" for x in rng.integers(0, 9, rng.integers(1, 12))}) for i in range(120)} | {500: []}
    df = spark.createDataFrame(list(sets.items()), "id long, grams array<string>")
    q = df.where("id % 5 = 0").withColumnRenamed("id", "q")
    jaccard = lambda a, b: (len(set(a) & set(b)), len(set(a) | set(b)))
    want = {(a, b, *jaccard(sets[a], sets[b])) for a in sets if a % 5 == 0 for b in sets if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b]))}
    for cells in (1 << 25, 400):
        monkeypatch.setattr(curate, "SET_CELLS", cells)
        found = curate.similar_sets(q, df, 0.5)
        assert {tuple(r) for r in found.collect()} == want
        assert found.count() == len(want)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert curate.similar_sets(q.where("q < 0"), df, 0.5).count() == 0
