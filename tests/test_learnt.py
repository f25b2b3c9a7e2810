"""Language profiles, topics, alignment of claims and snapshot trees."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import grounding, languages, snapshots, topics

# ---------------------------------------------------------------- languages

SIZE = 90
SPOKEN = {"aa": "kalo mira tenu sola vati", "bb": "strump groz kramp blitz dorf", "cc": "eau oui neuf peau jour"}


def plain_profile(texts, size):
    counts = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            p = f" {w} "
            counts.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_languages(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(SPOKEN[lang].split(), k=6)) + " 42!", lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    odd = [(100, None, "aa", "x"), (101, "", "aa", "x"), (102, "12 34 !?", "bb", "x"), (103, "kalo", None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id int, text string, lang string, guess string").repartition(4)
    profiles = languages.learn(docs, SIZE)
    got = {}
    for r in profiles.collect():
        got.setdefault(r.lang, {})[r["rank"]] = r.gram
    want = {lang: plain_profile([t for _, t, x, _ in rows + odd if x == lang and t], SIZE) for lang in SPOKEN}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    guessed = {r.doc_id: (r.guess, r.distance) for r in languages.guess(docs, profiles, SIZE).collect()}
    for i, t, lang, _ in rows + odd:
        mine = plain_profile([t or ""], SIZE)
        sums = sorted((sum(abs(k - p.index(g)) if g in p else SIZE for k, g in enumerate(mine)), x) for x, p in want.items())
        assert guessed[i] == ((sums[0][1], pytest.approx(sums[0][0] / (SIZE * len(mine)))) if mine else ("und", None))
        assert lang is None or not mine or guessed[i][0] == lang
    assert languages.accuracy(languages.guess(docs, profiles, SIZE), docs.select("doc_id", "lang").where("doc_id < 100")).first() == (60, 1.0)
    empty = languages.learn(docs.limit(0))
    assert empty.count() == 0 and {r.guess for r in languages.guess(docs, empty).collect()} == {"und"}


# ---------------------------------------------------------------- topics


def plain_em(docs, lean, k, rounds):
    vocab = sorted({w for d in docs.values() for w in d})
    p = {d: [(2 if lean[d] == i else 1) / (k + 1) for i in range(k)] for d in docs}
    for turn in range(rounds + 1):
        c = {w: [sum(p[d][i] * docs[d].get(w, 0) for d in docs) for i in range(k)] for w in vocab}
        t = [sum(c[w][i] for w in vocab) + topics.SMOOTHING * (len(vocab) + 1) for i in range(k)]
        lp = {w: [math.log((c.get(w, [0] * k)[i] + topics.SMOOTHING) / t[i]) for i in range(k)] for w in [*vocab, ""]}
        shares = [sum(p[d][i] for d in docs) / len(docs) for i in range(k)]
        if turn == rounds:
            return lp, shares
        for d in docs:
            logs = [math.log(max(shares[i], 1e-12)) + sum(n * lp[w][i] for w, n in docs[d].items()) for i in range(k)]
            e = [math.exp(x - max(logs)) for x in logs]
            p[d] = [round(x / sum(e), 6) for x in e]


def test_topics(spark):
    rng = random.Random(3)
    words = [[f"{a}{i}" for i in range(12)] for a in "xyz"]
    rows = [(i, " ".join(rng.choices(words[i % 3], k=15) + rng.choices(["the", "of"], k=5))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string")
    counts = topics.term_counts(docs)
    lean = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)).alias("h")).collect()}
    model, shares = topics.fit(counts, 3, 5)
    lp, want = plain_em({i: Counter(t.split()) for i, t in rows}, lean, 3, 5)
    assert shares == pytest.approx(want, abs=1e-3)
    got = {r.term: r.lp for r in model.collect()}
    assert set(got) == set(lp) and all(got[w] == pytest.approx(lp[w], abs=1e-3) for w in lp)
    again, _ = topics.fit(counts, 3, 5)
    assert sorted(map(str, again.collect())) == sorted(map(str, model.collect()))
    found = {r.doc_id: r.topic for r in topics.assign(counts, model, shares).collect()}
    assert len(found) == 60 and all(len({found[i] for i in range(a, 60, 3)}) == 1 for a in range(3))
    held = topics.term_counts(spark.createDataFrame([(500, "x1 x2 x3 the unseen"), (501, "y1 y4 of")], "doc_id long, text string"))
    one = topics.perplexity(held, *topics.fit(counts, 1, 0)).first()
    many = topics.perplexity(held, model, shares).first()
    assert one.n_words == many.n_words == 8 and many.perplexity < one.perplexity
    total = sum(math.log(sum(want[i] * math.exp(sum(lp.get(w, lp[""])[i] for w in t)) for i in range(3))) for t in (["x1", "x2", "x3", "the", "unseen"], ["y1", "y4", "of"]))
    assert many.perplexity == pytest.approx(math.exp(-total / 8), rel=1e-3)


@pytest.mark.parametrize("table", [0, 3, 9])
def test_packed_topics(spark, table, monkeypatch):
    """Numbered, joined and single terms have one model, documents in several runs too, and no count is shuffled in a round."""
    monkeypatch.setattr(topics, "ROWS", 7)
    rng = random.Random(4)
    docs = {i: Counter(rng.choices([f"w{j}" for j in range(8)], k=9) + [f"own{i}"] * (i % 3)) for i in range(12)}
    rows = spark.createDataFrame([(i, w, n) for i, c in docs.items() for w, n in c.items()], "doc_id long, term string, n long")
    lean = {r.doc_id: r.h for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).alias("h")).distinct().collect()}
    packed = topics.pack(rows.repartition(3), table)
    assert packed.n_names <= table and packed.docs.count() == 12
    model, shares = topics.fit(packed, 2, 3)
    lp, want = plain_em(docs, lean, 2, 3)
    got = {r.term: r.lp for r in model.collect()}
    assert shares == pytest.approx(want, abs=1e-3)
    assert set(got) == set(lp) and all(got[w] == pytest.approx(lp[w], abs=1e-3) for w in lp)
    given = packed.docs.selectExpr("doc_id", "array(1.0D, 1.0D) AS p", "array(1L) AS alone")
    plan = topics._round(packed, given, None, None, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


# ---------------------------------------------------------------- alignment


def plain_score(claim, text):
    best = 0
    table = [[0] * (len(claim) + 1) for _ in range(len(text) + 1)]
    for j, w in enumerate(text, 1):
        for i, c in enumerate(claim, 1):
            step = grounding.MATCH if w == c else -grounding.MISS
            table[j][i] = max(0, table[j - 1][i - 1] + step, table[j - 1][i] - grounding.MISS, table[j][i - 1] - grounding.MISS)
            best = max(best, table[j][i])
    return best


def test_align():
    rng = random.Random(10)
    for _ in range(400):
        claim, text = (rng.choices("abcd" if rng.random() < 0.5 else "abcdefghij", k=rng.randrange(12)) for _ in range(2))
        score, first, last, share = grounding.align(claim, text, band=30)
        assert score == plain_score(claim, text)
        if score:
            assert text[first] in claim and text[last] in claim and plain_score(claim, text[first : last + 1]) == score
            assert plain_score(claim, text[:last]) < score and share == score / (2 * len(claim))
        else:
            assert first is last is None
        assert grounding.align(claim, text, band=2)[0] <= score


def test_ground(spark):
    abstract = "we measure the mass of the star with a new method and find that it is twice the mass of the sun"
    claims = ["it is twice the mass of the sun", "it is twice the size of the sun", "the sun is of mass the twice it", "it is twice", "nothing here", "", None]
    df = spark.createDataFrame([(i, c, abstract, 1) for i, c in enumerate(claims)] + [(9, "a", None, 1)], "id int, claim string, text string, score int")
    rows = {r.id: r for r in grounding.ground(df).collect()}
    share = [rows[i].alignment.share for i in range(5)]
    assert share[0] == 1 and share[0] > share[1] > share[2] > share[4] == 0 and rows[0].score == 1
    words = abstract.split()
    assert words[rows[0].alignment["first"] : rows[0].alignment["last"] + 1] == claims[0].split()
    assert rows[3].alignment.share == 1  # all of a short claim
    for i in (4, 5, 6, 9):
        assert tuple(rows[i].alignment) == (0, None, None, 0.0)


# ---------------------------------------------------------------- snapshots


def test_snapshots(spark, tmp_path):
    one = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("bucket"))
    changed = {5: "changed", 777: "changed", 19_999: "removed", 123: "removed", 20_500: "added"}
    v = F.when(F.col("k").isin(5, 777), F.lit(None).cast("string")).otherwise(F.col("v"))
    other = one.where(~F.col("k").isin(19_999, 123)).withColumn("v", v).unionAll(spark.range(20_500, 20_501).select("id", F.lit("new"), F.lit(1)))
    a = snapshots.build(one, "k", str(tmp_path / "a"), leaf=10)
    depth = a.state()["facts"]["depth"]
    assert depth == 3 == snapshots.depth_for(20_000, 10) and snapshots.depth_for(10, 10) == 0
    b = snapshots.build(other.repartition(7), "k", str(tmp_path / "b"), depth)
    assert {int(r.key): r.change for r in snapshots.difference(a, b).collect()} == changed
    buckets, read = snapshots.differing(a, b)
    assert buckets.count() <= 5 and read <= 2 * (1 + 16 * 5 * depth)
    assert snapshots.difference(a, a).count() == 0 and snapshots.differing(a, a)[1] == 2
    with pytest.raises(ValueError, match="depth"):
        snapshots.difference(a, snapshots.build(other, "k", str(tmp_path / "c"), 0))
    # null keys, repeated keys, nothing at all
    odd = spark.createDataFrame([(None, "x"), (1, "a"), (1, "b"), (2, "c"), (2, "c")], "k int, v string")
    later = spark.createDataFrame([(None, "y"), (1, "b"), (1, "a"), (2, "c")], "k int, v string")
    trees = [snapshots.build(x, "k", str(tmp_path / str(i)), 1) for i, x in enumerate((odd, later, odd.limit(0)))]
    assert {r.key: r.change for r in snapshots.difference(trees[0], trees[1]).collect()} == {None: "changed", "2": "changed"}
    assert {r.key: r.change for r in snapshots.difference(trees[2], trees[1]).collect()} == {None: "added", "1": "added", "2": "added"}
