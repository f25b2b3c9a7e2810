"""Vector, positional and segmented indexes, versions, citation chains and paged streams."""

import itertools
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ann, blocks, citations, frontiers, positional, ranking, segments
from corvane.sources import readers, versions
from corvane.sources.versions import Conflict, Versions
from corvane.streaming import pages

# ---------------------------------------------------------------- vectors


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24)) * 2
    rows = [(i, (centres[i % 12 if i % 3 else 0] + rng.normal(size=24)).tolist()) for i in range(1500)]  # cell 0 is hot
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [1.0, 2.0]), (2003, [float("nan")] * 24), (2004, rows[7][1]), (2005, rows[7][1])]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    queries = vectors.where("doc_id % 50 = 0 and doc_id < 2000").select(F.col("doc_id").alias("query_id"), "vector")
    return vectors, queries


def test_ann(spark, clouds, tmp_path):
    vectors, queries = clouds
    good = vectors.where("doc_id not in (2002, 2003)")
    exact = ranking.dense_topk(queries, good, 10, 9)
    index = ann.build(vectors, str(tmp_path / "i"), cells=20, parts=8)
    held = index.read(ann.CODES).select("cell", F.explode("doc_ids").alias("doc_id")).collect()
    assert Counter(r.doc_id for r in held) == Counter(r.doc_id for r in vectors.collect())
    assert {r.doc_id for r in held if r.cell == -1} == {2000, 2001, 2002, 2003}
    found = ann.search(index, queries, vectors, 10, probes=8, shortlist=60, decimals=9)
    assert ann.recall(found, exact).first().recall >= 0.97
    whole = ann.search(index, queries, vectors, 10, probes=99, shortlist=2000, decimals=9)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows(whole) == rows(exact)
    assert index.state()["facts"]["probes"] < 20
    assert ann.recall(ann.search(index, queries, vectors, 10, decimals=9), exact).first().recall >= 0.97
    few = ann.recall(ann.search(index, queries, vectors, 10, probes=1, shortlist=10), exact).first().recall
    assert few < 1  # the measure tells
    with pytest.raises(ValueError, match="already exists"):
        ann.build(vectors, str(tmp_path / "i"))


def test_ann_blocks(spark, clouds, tmp_path, monkeypatch):
    """Cells of many blocks, and queries of many blocks, give what single ones give."""
    vectors, queries = clouds
    index = ann.build(vectors, str(tmp_path / "one"), cells=3, parts=5)
    want = sorted(map(tuple, ann.candidates(index, queries, 2, 30).collect()))
    monkeypatch.setattr(ann, "BLOCK", 37)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    index = ann.build(vectors, str(tmp_path / "many"), cells=3, parts=5)
    sizes = [r.n for r in index.read(ann.CODES).select(F.size("doc_ids").alias("n")).collect()]
    assert max(sizes) <= 37 and len(sizes) > 30
    assert sorted(map(tuple, ann.candidates(index, queries, 2, 30).collect())) == want


def test_ann_dealt(spark, clouds, tmp_path, monkeypatch):
    """A hot cell goes to several tasks, these cut what they hold, and the candidates stay the same."""
    vectors, queries = clouds
    monkeypatch.setattr(ann, "BLOCK", 37)
    index = ann.build(vectors, str(tmp_path / "i"), cells=3, parts=5)
    want = sorted(map(tuple, ann.candidates(index, queries, 2, 30).collect()))
    monkeypatch.setattr(ann, "PAIRS", 3000)
    monkeypatch.setattr(ann, "HELD", 2000)
    assert sorted(map(tuple, ann.candidates(index, queries, 2, 30).collect())) == want
    codes = index.read(ann.CODES)
    asked = spark.createDataFrame([(c, [7] * 30) for c in range(3)], "cell int, query_ids array<int>")
    tasks = ann._dealt(codes, asked).groupBy("cell").agg(F.countDistinct("share").alias("n"), F.count("*").alias("rows")).collect()
    assert max(t.n for t in tasks) > 3
    assert {t.cell: t.rows for t in tasks} == {r.cell: r["count"] for r in codes.where("cell >= 0").groupBy("cell").count().collect()}


def test_ann_odd(spark, tmp_path):
    one = spark.createDataFrame([("a", [3.0, 4.0]), (None, [3.0, 4.0])], "doc_id string, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("null", None), ("zero", [0.0, 0.0])], "query_id string, vector array<double>")
    index = ann.build(one, str(tmp_path / "i"))
    assert [(r.query_id, r.doc_id, r.score) for r in ann.search(index, q, one, 5, decimals=6).collect()] == [("q", "a", 0.6)]
    with pytest.raises(ValueError, match="no vectors"):
        ann.build(one.limit(0), str(tmp_path / "none"))


# ---------------------------------------------------------------- positions

TEXTS = [(1, "A tall Tree", "the tree is tall and the tree is old"), (2, None, "the old tree"), (3, "", None), (4, "tree", "tree tree tree"), (4, "The tree", "is"), (None, "x", "the tree is x"), (5, "the", "is tree"), (6, "émile's tree", "is Été")]


def plain_positions(texts):
    docs = []
    for i, (d, *parts) in enumerate(texts):
        at = [(w, label) for label, p in zip("AD", parts) for w in re.findall(r"\w+", (p or "").lower().replace("é", "e"))]
        docs.append((i, d, at))
    return docs


@pytest.fixture(scope="module")
def positions(spark):
    docs = spark.createDataFrame([(*t, 9) for t in TEXTS], "doc_id long, title string, body string, row int")
    return positional.index_positions(docs, {"title": "A", "body": "D"}).cache()


def test_positions(positions):
    got = [(r.doc_id, r.term, np.cumsum(r.gaps).tolist(), r.labels) for r in positions.collect()]
    want = []
    for _, d, at in plain_positions(TEXTS):
        for w in {w for w, _ in at}:
            want.append((d, w, [i for i, (x, _) in enumerate(at, 1) if x == w], "".join(label for x, label in at if x == w)))
    assert sorted(got, key=str) == sorted(want, key=str)


PHRASES = ["the tree is", "tree tree", "tree", "is", "tall tree the", "the the", "nowhere tree", "", "Emile S  TREE", "tree is tall and the tree is old"]


@pytest.mark.parametrize("only", [None, "A", "D", "AD"])
def test_phrases(spark, positions, only):
    queries = spark.createDataFrame(list(enumerate(PHRASES)), "query_id int, query string")
    got = [(r.query_id, r.doc_id, r.n, r["first"]) for r in positional.phrase_search(positions, queries, only).collect()]
    near = [(r.query_id, r.doc_id, r.span) for r in positional.near_search(positions, queries, 4, only).collect()]
    want, want_near = [], []
    for q, phrase in enumerate(PHRASES):
        words = re.findall(r"\w+", phrase.lower())
        for _, d, at in plain_positions(TEXTS):
            here = [w if only is None or label in only else None for w, label in at]
            starts = [i + 1 for i in range(len(here) - len(words) + 1) if words and here[i : i + len(words)] == words]
            if starts:
                want.append((q, d, len(starts), starts[0]))
            spans = [b - a for a, b in itertools.combinations(range(len(here) + 1), 2) if words and set(words) <= set(here[a:b])]
            if spans and min(spans) <= 4:
                want_near.append((q, d, min(spans)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(near, key=str) == sorted(want_near, key=str)


def test_weighted_and_empty(spark, positions):
    queries = spark.createDataFrame([(1, "tree"), (2, "")], "query_id int, query string")
    got = {(r.doc_id, r.score) for r in positional.weighted_search(positions, queries, 99, decimals=6).collect()}
    assert {(1, 1.2), (4, 1.3), (4, 1.0), (2, 0.1), (None, 0.1), (6, 1.0), (5, 0.1)} == got
    assert not positional.phrase_search(positions.limit(0), queries).count()
    with pytest.raises(ValueError, match="labels"):
        positional.index_positions(spark.createDataFrame([(1, "x")], "doc_id int, text string"), {"text": "Z"})


# ---------------------------------------------------------------- versions


def test_versions(spark, tmp_path, monkeypatch):
    root = Versions(spark, str(tmp_path / "v"))
    assert root.state()["version"] == -1 and root.numbers() == []
    one, two = spark.range(3), spark.range(5).select(F.col("id").cast("string").alias("name"))
    assert root.load({"a": one, "b": two}) == 0
    pinned = root.state()
    with pytest.raises(ValueError, match="already exists"):
        root.load({"a": one})

    # a writer that dies between its tables changes nothing
    plain = Versions.stage
    monkeypatch.setattr(Versions, "stage", lambda self, df, name, p=None: 1 / 0 if name == "b" else plain(self, df, name, p))
    with pytest.raises(ZeroDivisionError):
        root.load({"a": spark.range(100), "b": two}, reset=True)
    monkeypatch.undo()
    assert root.numbers() == [0] and root.read("a").count() == 3 and root.read("b").count() == 5

    assert root.load({"a": spark.range(7), "b": two.limit(0)}, reset=True) == 1
    assert (root.read("a").count(), root.read("b").count()) == (7, 0)
    assert (root.read("a", pinned).count(), root.read("b", pinned).count()) == (3, 5)
    assert root.read("b").columns == two.columns
    with pytest.raises(ValueError, match="no version 9"):
        root.state(9)

    # two writers from one base: one wins, the other's folders stay unnamed
    base, late = root.state()["version"], root.stage(spark.range(1), "a")
    assert root.commit({"a": root.stage(spark.range(2), "a")}, base) == 2
    with pytest.raises(Conflict):
        root.commit({"a": late}, base)
    assert root.read("a").count() == 2
    gone = root.vacuum(keep=1)
    assert f"data/{late['folders'][0]}" in gone and root.numbers() == [2] and root.read("a").count() == 2
    assert not versions.put_new(spark, "x", f"{root.root}/_log/{2:020d}.json")


def test_index_versions(spark, tmp_path):
    q = spark.createDataFrame([(1, "gamma beta")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    first = ranking.build_index(docs, str(tmp_path / "i"))
    ranking.build_index(docs.where("doc_id = 1"), str(tmp_path / "i"), reset=True)
    ids = lambda v: sorted(r.doc_id for r in ranking.search_index(q, str(tmp_path / "i"), 5, v).collect())
    assert ids(first) == [1, 2] and ids(None) == [1]


def test_index_is_shuffled_in_blocks(spark, tmp_path, monkeypatch):
    """Small blocks, ranges and chunks, with folded words, a term of several ranges, repeated and null doc_ids: the postings of a plain count, in order, and no row of one shuffled."""
    rng = random.Random(3)
    words = ["naïve", "Été", "x1", "the", "²half", "中文", "zażółć", *(f"w{i}" for i in range(60))]
    rows = [(i, " the ".join(rng.choices(words, k=1 + i % 9)) + "." * (i % 2)) for i in range(300)]
    rows += [(7, "naive the"), (8, rows[8][1]), (None, "the été"), (None, "x1 x1"), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(str, ranking.postings(docs).select("doc_id", "len", "term", "tf").collect()))
    stats = ranking.corpus_stats(docs).first()
    for name, size in (("BLOCK", 16), ("FILE", 40), ("HELD", 64)):
        monkeypatch.setattr(blocks, name, size)
    index = Versions(spark, str(tmp_path / "i"))
    assert ranking.build_index(docs, index.root) == 0 and tuple(index.read("stats").first()) == pytest.approx(tuple(stats))
    assert sorted(map(str, index.read("postings").collect())) == want
    assert [f.dataType.simpleString() for f in index.read("postings").schema] == ["bigint", "bigint", "string", "bigint"]
    once = docs.where("doc_id > 8 and doc_id < 900")
    made = blocks.by_term(once)
    parts = made.withColumn("p", F.spark_partition_id()).collect()
    assert sorted(map(str, made.collect())) == sorted(map(str, ranking.postings(once).select(made.columns).collect()))
    runs = [[r.term for r in parts if r.p == p] for p in sorted({r.p for r in parts})]
    assert len(runs) > 10 and all(x == sorted(x) for x in runs) and all(a[-1] <= b[0] for a, b in zip(runs, runs[1:]) if a[0] != a[-1] and b[0] != b[-1])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert all("term" not in line and "doc_id" not in line for line in plan.splitlines() if "Exchange" in line and "ROUND" not in line.upper())


# ---------------------------------------------------------------- segments


def test_segments(spark, tmp_path):
    """Random increments with replacements and removals against a full build, after each; merges happen."""
    rng = random.Random(4)
    vocab = ["ant", "bee", "cat", "dog", "eel", "fox"]
    index, live = Versions(spark, str(tmp_path / "s")), {}
    q = spark.createDataFrame([(1, "ant fox"), (2, "bee bee cat"), (3, "nothing")], "query_id long, query string")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for turn in range(6):
        texts = {i: " ".join(rng.choices(vocab, k=rng.randrange(9))) or None for i in rng.sample(range(40), 12)}
        removed = rng.sample(range(40), 4) if turn else []
        version = segments.refresh(index, frame(list(texts.items())), frame([(i, None) for i in removed]) if removed else None, fan=2)
        live = {i: t for i, t in live.items() if i not in removed} | texts
        full = ranking.lexical_topk(q, frame(list(live.items())), 50, decimals=9)
        rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
        want = rows(full)
        assert rows(segments.search(index, q, 50, decimals=9)) == want
        assert segments.statistics(index) == (len(live), pytest.approx(sum(len((t or "").split()) for t in live.values()) / len(live)))
        seen[version] = want
    names = index.state()["facts"]["segments"]
    assert len(names) < 6  # merged
    version, want = sorted(seen.items())[2]
    assert rows(segments.search(index, q, 50, version, decimals=9)) == want  # an old version still answers
    segments.refresh(index, None, frame([(i, None) for i in range(40)]), fan=2)
    assert segments.search(index, q, 5).count() == 0 and segments.statistics(index) == (0, None)
    index.vacuum(1)
    segments.refresh(index, frame([(1, "ant")]), fan=0)
    assert [r.doc_id for r in segments.search(index, q, 5).collect()] == [1]


# ---------------------------------------------------------------- citation chains


def test_citation_chains_long(spark, monkeypatch):
    """Paths are summed as whole numbers while these can't overflow, then as decimals."""
    layers = [[(i, j) for i in range(a, a + 4) for j in range(a + 4, a + 8)] for a in range(0, 24, 4)]
    edges = spark.createDataFrame([e for layer in layers for e in layer], "source long, target long")
    starts = spark.createDataFrame([(0,)], "id long")
    want = sorted((n, n // 4, 4 ** (n // 4 - 1)) for n in range(4, 28))
    for least in (citations.LONG, 60, 2):
        monkeypatch.setattr(citations, "LONG", least)
        got = citations.citation_chains(edges, starts, 9)
        assert got.schema["paths"].dataType.simpleString() == "decimal(38,0)"
        assert sorted((r.node, r.hops, int(r.paths)) for r in got.collect()) == want


@pytest.mark.parametrize("dense", [0, 9])
def test_citation_products(dense, monkeypatch):
    """Products as a matrix and row by row, in small pieces, give the sums of a plain loop, and fewer rows than edges and entries make."""
    monkeypatch.setattr(citations, "PRODUCTS", 50)
    rng = random.Random(6)
    edges = sorted({(rng.randrange(12), rng.randrange(9)) for _ in range(70)})
    entries = sorted({(rng.randrange(2, 14), s): rng.randrange(1, 5) for s in (3, 5, 8) for _ in range(9)}.items())
    want = Counter()
    for a, t in edges:
        for (n, s), p in entries:
            if n == a:
                want[s, t] += p
    columns = np.array(edges).T, np.array([(n, s, p) for (n, s), p in entries]).T
    got, rows = Counter(), 0
    for part in citations._sums(tuple(columns[0]), tuple(columns[1]), dense):
        rows += len(part[0])
        for s, t, p in zip(*(x.tolist() for x in part), strict=True):
            got[s, t] += p
    assert got == want and rows < sum(n == a for a, _ in edges for (n, _), _ in entries)


@pytest.mark.parametrize(("full", "cells"), [(0, 96), (9, 96), (9, 1 << 20)])
def test_packed_products(full, cells, monkeypatch):
    """A block's products with a packed frontier, through edges and through entries, are the sums of a plain loop."""
    monkeypatch.setattr(frontiers, "FULL", full)
    monkeypatch.setattr(frontiers, "CELLS", cells)
    rng = random.Random(7)
    for many in (3, 90):
        edges = sorted({(rng.randrange(16), rng.randrange(40) - 20) for _ in range(150)})
        entries = {(rng.randrange(16), rng.randrange(5)): rng.randrange(1, 300) for _ in range(many)}
        want = Counter()
        for a, t in edges:
            for (n, s), p in entries.items():
                if n == a:
                    want[t, s] += p
        nodes, targets = np.array(edges).T
        block = frontiers.Block(nodes.astype(np.uint32), targets, 4)
        codes = np.array([n * frontiers.STARTS + s for n, s in entries])
        got = [x for part in block.products(codes, np.array(list(entries.values())), 5) for x in zip(*(c.tolist() for c in part), strict=True)]
        assert {(t, s): p for t, s, p in got} == want and len(got) == len(want)


def test_citation_chains_are_packed(spark, monkeypatch):
    """Frontiers in small blocks, edges of one block in several tasks: the rows of joins, and a packed row for many of these."""
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(200) - 60, rng.randrange(200) - 60) for _ in range(500)] + [(5, n) for n in range(120)], "source long, target int")
    starts = spark.createDataFrame([(i,) for i in range(-20, 60)] + [(10**12,), (None,)], "id long")
    monkeypatch.setattr(citations, "RANGE", 0)
    want = sorted(map(tuple, citations.citation_chains(edges, starts, 4).collect()))
    monkeypatch.setattr(citations, "RANGE", 64)
    monkeypatch.setattr(frontiers, "HELD", 30)
    monkeypatch.setattr(frontiers, "BITS", (4, 5))
    steps, made = frontiers.step, []
    monkeypatch.setattr(frontiers, "step", lambda *a: made.append(steps(*a)) or made[-1])
    got = citations.citation_chains(edges, starts, 4)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 4000
    assert len(made) == 4 and sum(x.count() for x in made) < len(want) / 20


def test_citation_chains(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)] + [(1, 1), (None, 3), (3, None), (0, 1), (1, 0)] * 2
    df = spark.createDataFrame([(*e, "x") for e in edges], "source int, target int, node string")
    starts = spark.createDataFrame([(0,), (5,), (None,), (77,), (5,)], "id int")
    near = defaultdict(set)
    for a, b in edges:
        if None not in (a, b) and a != b:
            near[a].add(b)
    for depth in (1, 4, 9):
        got = citations.citation_chains(df, starts, depth)
        want = []
        for s in (0, 5, 77):
            dist, paths, level = {s: 0}, Counter({s: 1}), [s]
            for hop in range(1, depth + 1):
                fresh = Counter()
                for a in level:
                    for b in near[a]:
                        if b not in dist:
                            fresh[b] += paths[a]
                for b in fresh:
                    dist[b] = hop
                paths += fresh
                level = list(fresh)
            want += [(s, n, h, paths[n]) for n, h in dist.items() if h]
        assert sorted((r["start"], r.node, r.hops, int(r.paths)) for r in got.collect()) == sorted(want)
    via = {(r["start"], r.node): r.via for r in citations.lineage(got, df).collect()}
    hops = {(s, n): h for s, n, h, _ in want}
    assert set(via) == set(hops)
    for (s, n), v in via.items():
        assert n in near[v] and hops.get((s, v), 0) == hops[s, n] - 1


# ---------------------------------------------------------------- paged streams

CALLS: list = []
HELD = [{"bibcode": f"b{i % 23}", "n": i} for i in range(27)]  # four keys come twice


def api(start, rows):
    CALLS.append((start, rows))
    return HELD[start : start + rows]


def broken_api(start, rows):
    if rows > 1 and start >= 12:
        raise OSError("down")
    return api(start, rows)


@pytest.fixture
def as_module(spark):
    """Workers import the functions above by this file's name."""
    import os

    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(__file__), env.get("PYTHONPATH", "")]))
    sys.modules.setdefault("test_indexes", sys.modules[__name__])


def test_available():
    for n in range(12):
        rows = list(range(n))
        for start, most in itertools.product(range(13), range(15)):
            assert pages.available(lambda s, k, rows=rows: rows[s : s + k], start, most) == max(0, min(most, n - start))


def test_paged_ingest_resumes(spark, as_module, tmp_path):
    args = ("bibcode string, n int", "bibcode", str(tmp_path / "out"), str(tmp_path / "mark"))
    with pytest.raises(Exception, match="down"):
        pages.ingest_pages(spark, "test_indexes:broken_api", *args, page=4, pages=3)
    done = spark.read.parquet(args[2])
    assert sorted(r.n for r in done.collect()) == list(range(12))  # the first batch is in, the second isn't
    batches = pages.ingest_pages(spark, "test_indexes:api", *args, page=4, pages=3)
    assert batches == 2
    rows = spark.read.parquet(args[2]).collect()
    assert sorted(r.bibcode for r in rows) == sorted({r["bibcode"] for r in HELD})
    assert pages.ingest_pages(spark, "test_indexes:api", *args, page=4, pages=3) == 0


def test_paged_batch_stops(spark, as_module):
    df = readers.read_paged(spark, "test_indexes:api", "bibcode string, n int", limit=500, page=4)
    assert df.rdd.getNumPartitions() == 7 and sorted(r.n for r in df.collect()) == list(range(27))


def test_positions_of_a_document_come_from_its_row(spark, monkeypatch):
    rows = [(1, "b a b", "a c"), (1, None, "c c"), (None, "", "é E"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    for step in (64, 1):
        monkeypatch.setattr(positional, "STEP", step)
        got = {(r.doc_id, r.term, tuple(r.gaps), r.labels) for r in positional.index_positions(docs, {"title": "A", "body": "D"}).collect()}
        assert got == {(1, "b", (1, 2), "AA"), (1, "a", (2, 2), "AD"), (1, "c", (5,), "D"), (1, "c", (1, 1), "DD"), (None, "e", (1, 1), "DD")}
    index = positional.index_positions(docs, {"title": "A", "body": "D"})
    queries = spark.createDataFrame([(1, "a c"), (2, "b zz")], "query_id long, query string")
    found = positional.weighted_search(index, queries, 5, decimals=9)
    exchanges = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert not any("query_id" in x and "row" in x for x in exchanges)
    assert {(r.query_id, r.doc_id, r.score) for r in found.collect()} == {(1, 1, 1.2), (1, 1, 0.2), (2, 1, 2.0)}


def test_what_is_gone_is_taken_off_without_a_shuffle(spark, tmp_path, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" all")).alias("text"))
    index = Versions(spark, str(tmp_path / "x"))
    segments.refresh(index, docs, fan=0)
    segments.refresh(index, docs.where("doc_id % 3 = 0").withColumn("text", F.lit("new all")), fan=0)
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 5)  # fewer than are gone
    state = segments._state(index)
    rows = segments._live(index, state, segments.POSTINGS, terms=spark.createDataFrame([("all",), ("new",)], "term string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert sorted(r.doc_id for r in rows.where("term = 'all'").collect()) == list(range(40)) and rows.where("term = 'new'").count() == 14
    monkeypatch.setattr(segments, "GONE_ROWS", 1)
    assert sorted(r.doc_id for r in segments._live(index, state, segments.POSTINGS).where("term = 'all'").collect()) == list(range(40))
