"""Fill-in-middle, sharding and lexical search against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import fim, lexical, sharding

ODD = [None, "", " ", "a", "ab", "é", "aé", "éa", "a1b", "<P>", "x<S>y", "<M", "<<P>", "P>S>", "<p>", "<PS>", "\n", "a\nb", "日本語 text", "\U0001f600ab\U0001f600", "zz" * 500, "<", "<<<>>>", "a<b>c"]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", 1, "x", 2, 3, 4, 5, 6) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, output string, size int, shard int, place int, part int, row int")


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(11)
    letters = ["the", "of", "Rain", "x", "é", "über", "a1", "42", "ÀB", "straße", *("w%d" % i for i in range(60))]
    texts = [" ".join(rng.choices(letters, k=rng.choice([1, 2, 5, 30, 200]))) for _ in range(400)] + ODD
    texts += [texts[0]] * 150 + [texts[5]] * 3  # a hot text and a few copies
    rng.shuffle(texts)
    return [(None if i == 7 else 5 if i == 9 else i, t) for i, t in enumerate(texts)]


# ---------------------------------------------------------------- fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, x), (x, y), (y, n)))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_operator(spark, documents):
    got = fim.transform(frame(spark, documents)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *plain_fim(i, t)) for i, t in documents], key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_report_and_rewrite(spark, documents):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = fim.report(frame(spark, documents)).collect()
    want = [(i, *plain_fim(i, t)[:4], sha(plain_fim(i, t)[4]), sha(t)) for i, t in documents]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    df = frame(spark, documents)
    out = fim.rewrite(df)
    assert out.schema == df.schema
    want = [(i, None if t is None else plain_fim(i, t)[4], "en", 1, "x", 2, 3, 4, 5, 6) for i, t in documents]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert fim.report(frame(spark, [])).count() == 0


def test_fim_slices(monkeypatch):
    """Events on the borders of slices, for every small slice and every offset."""
    automaton, rng = fim.build_automaton(), random.Random(3)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(fim, "_SLICE", size)
        for _ in range(300):
            text = "".join(rng.choices(["a", "Z", "<P>", "<", ">", "M", " ", "é", "7"], k=rng.randrange(12)))
            units = fim.Units(text, automaton)
            parts = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
            assert units.count == len(parts) and units.sentinel == bool(re.search("<[PSM]>", text))
            assert [units.offset(r) for r in range(len(parts) + 1)] == [len("".join(parts[:r])) for r in range(len(parts) + 1)]


# ---------------------------------------------------------------- sharding


def plain_shards(documents, shards):
    groups = defaultdict(int)
    for _, t in documents:
        groups[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 1
    heap = [(0, s) for s in range(shards)]
    out = {}
    for digest, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        load, shard = heapq.heappop(heap)
        out[digest] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, documents, shards):
    got = sharding.assign(frame(spark, documents).repartition(5), shards).collect()
    where = plain_shards(documents, shards)
    want = Counter()
    for i, t in documents:
        data = (t or "").encode()
        want[i, len(data) + 1, zlib.crc32(data), where[hashlib.sha256(data).digest()]] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == want
    for s in range(shards):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in mine]
        assert ids == sorted(ids)


def test_sharding_turns():
    """Runs of equal sizes against a heap over single groups, with very unequal loads before."""
    rng = random.Random(8)
    for _ in range(300):
        k = rng.choice([1, 2, 5, 8])
        loads, heap = sharding.Loads(k), [(0, s) for s in range(k)]
        for size in sorted(rng.choices([1, 2, 3, 7, 50, 1000], k=6), reverse=True):
            count = rng.choice([1, 2, 9, 400])
            turns = loads.put(size, count)
            for at in range(count):
                load, shard = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, shard))
                start, order = [t for t in turns if t[0] <= at][-1]
                assert order[(at - start) % len(order)] == shard
            assert len(turns) <= k
        assert sorted(heap, key=lambda x: x[1]) == [(b, s) for s, b in enumerate(loads.bytes)]
    assert sharding.Loads(4).put(3, 10**15)[0] == (0, [0, 1, 2, 3])


def test_sharding_empty(spark):
    assert sharding.report(frame(spark, [])).count() == 0
    assert sharding.report(frame(spark, [(1, None)])).collect()[0].asDict() == {"doc_id": 1, "size": 1, "text_crc32": 0, "law": "bytes", "shard": 0, "slot": 0, "grown_shard": None}


# ---------------------------------------------------------------- lexical search


def terms(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_search(documents, items, k):
    docs = [(i, Counter(terms(t))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in docs:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


ITEMS = [(1, "rain of the w3 w3"), (2, ""), (3, None), (4, "nowhere"), (5, "STRAßE über w7"), (None, "w1 w2 w3 w4 w5"), (1, "rain of the w3 w3"), (8, "x"), (9, "日本語"), (10, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("k, block_words, size", [(20, 200_000, 4096), (3, 200_000, 40), (20, 7, 40), (1, 200_000, 1), (700, 30, 17)])
def test_search(spark, documents, k, block_words, size, monkeypatch):
    monkeypatch.setattr(lexical, "ranges", lambda rows, plain=lexical.ranges: plain(rows, size, 5000))
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, score int")
    got = lexical.search(frame(spark, documents).repartition(3), items, k, block_words).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_search(documents, ITEMS, k), key=str)


def test_search_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(frame(spark, []), items).count() == 0
    assert lexical.search(frame(spark, [(1, None), (2, "...")]), items).count() == 0
    assert lexical.search(frame(spark, [(1, "rain")]), items.limit(0)).count() == 0


def test_search_ties(spark):
    """Thousands of copies tie: the smallest ids win, across ranges and tasks."""
    docs = [(9000 - i, "same words here") for i in range(9000)] + [(-i, "other text") for i in range(1, 2000)]
    items = spark.createDataFrame([(1, "same here")], "item_id long, text string")
    got = lexical.search(frame(spark, docs).repartition(4), items, 20).collect()
    assert sorted((r.rank, r.doc_id) for r in got) == [(i, i) for i in range(1, 21)]


def test_tree_prunes():
    """Best-first opens few nodes where one document stands out."""
    rng = np.random.default_rng(1)
    rows = [(i, 50, [0], [1 + int(rng.integers(3))]) for i in range(4096)]
    rows[1234] = (1234, 50, [0], [40])
    tree = lexical.tree_of(rows, 4096, 4096 * 50)
    opened, plain = [], tree.open
    tree.open = lambda *a: opened.append(a) or plain(*a)
    best = []
    lexical.best_first(tree, list(range(4096)), np.array([5]), best, 1)
    assert best[0][1] == -1234 and len(opened) == 3
