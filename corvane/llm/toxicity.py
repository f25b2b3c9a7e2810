"""Toxicity with a factorization machine over hashed terms.

A text's terms are its lower-cased words and the first letters of longer words
(``STEMS``), hashed into ``2**bits`` buckets, presence only. The score is

    sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the buckets present, so a pair of terms can weigh more, or less, than the
sum of its parts. Fitting has two steps, both on a sample of the labelled rows
that is bounded by ``max_rows`` (the rows with the smallest hash of doc_id):

1. the ``max_buckets`` buckets that tell most about the label, for it or against
   it, are selected by rank of chi-squared and without a floor, so that few rows
   select by the same rule as many; to them come the ``pair_buckets`` most frequent others, which
   get no weight of their own but may weigh in pairs. Counted with Spark over the
   whole sample;
2. the machine is fitted to the selected buckets with Adam in the driver, in
   ``steps`` steps at least.

Buckets not selected have no weight, so the length of a text adds no noise. The
bias is moved by the log odds of the labels, so a score is the probability if
both labels were equally frequent: toxic texts are rare, and without that a text
with as much evidence for the label as against it would score far below a half.

Defined results: null and empty texts have no terms and get the score of the
bias alone; rows of ``labels`` with a null label or doc_id are not learnt from;
a doc_id with contradicting labels counts as toxic, and of rows that repeat a
doc_id the one with the first terms is learnt from; with no positive or no
negative label every score is the share of positives (0 without labels).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .arrowio import map_rows

STEMS = (3, 4, 5)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Machine:
    bias: float
    buckets: np.ndarray  # sorted selected buckets
    linear: np.ndarray
    factors: np.ndarray  # one row for each bucket
    bits: int

    def score(self, at: np.ndarray) -> float:
        """The score of a text with these places among the selected buckets."""
        return float(1 / (1 + np.exp(-np.clip(self.bias + margin(self.linear[at], self.factors[at]), -40, 40))))


def margin(linear: np.ndarray, factors: np.ndarray) -> float:
    total = factors.sum(0)
    return linear.sum() + 0.5 * float((total * total).sum() - (factors * factors).sum())


class Terms(dict):
    """word -> its buckets, or its places among the ``selected`` ones; of ``limit`` words at most."""

    def __init__(self, bits: int, selected: np.ndarray | None = None, limit: int = 100_000):
        super().__init__()
        self.mask, self.limit = (1 << bits) - 1, limit
        self.places = None if selected is None else {b: i for i, b in enumerate(selected.tolist())}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        forms = ["=" + word, *(f"{n}{word[:n]}" for n in STEMS if len(word) >= n)]
        buckets = [zlib.crc32(x.encode()) & self.mask for x in forms]
        if self.places is not None:
            buckets = [self.places[b] for b in buckets if b in self.places]
        found = self[word] = tuple(buckets)
        return found

    def of_text(self, text: str | None) -> np.ndarray:
        """Sorted distinct buckets or places of a text."""
        found: set[int] = set()
        for word in set(_LETTERS.findall(text.lower())) if text else ():
            if some := self[word]:
                found.update(some)
        return np.array(sorted(found), np.int64)


def train_rows(labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, y of at most ``max_rows`` rows from which labels may be learnt."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def held_out(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1


def fit_machine(x: list[np.ndarray], y: np.ndarray, n_buckets: int, rank: int, epochs: int, rate: float, decay: float, pair_decay: float, seed: int, alone: np.ndarray | None = None, steps: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the log loss, in mini-batches; x holds positions among the buckets.

    Buckets where ``alone`` is 0 get factors, but no linear weight. There are
    ``steps`` steps at least, so that few rows are fitted as far as many.
    """
    epochs = max(epochs, -(-steps // max(1, -(-len(x) // 256))))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(n_buckets), rng.normal(0, 0.01, (n_buckets, rank)), np.array([np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (b, w, v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            sizes = np.array([len(x[r]) for r in rows])
            ids = np.concatenate([x[r] for r in rows]) if sizes.sum() else np.empty(0, np.int64)
            of = np.repeat(np.arange(len(rows)), sizes)
            vi = v[ids]
            total = np.zeros((len(rows), rank))
            np.add.at(total, of, vi)
            square = np.zeros(len(rows))
            np.add.at(square, of, (vi * vi).sum(1))
            line = np.zeros(len(rows))
            np.add.at(line, of, w[ids])
            p = 1 / (1 + np.exp(-np.clip(b[0] + line + 0.5 * ((total * total).sum(1) - square), -40, 40)))
            g = (p - y[rows]) / len(rows)
            gw, gv = np.zeros_like(w), np.zeros_like(v)
            np.add.at(gw, ids, g[of])
            np.add.at(gv, ids, g[of, None] * (total[of] - vi))
            if alone is not None:
                gw *= alone
            step += 1
            for p_, g_, s in zip((b, w, v), (np.array([g.sum()]), gw + decay * w / len(x), gv + pair_decay * v / len(x)), state, strict=True):
                s[0] += 0.1 * (g_ - s[0])
                s[1] += 0.001 * (g_ * g_ - s[1])
                p_ -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    return float(b[0]), w, v


def fit(
    documents: DataFrame, labels: DataFrame, max_rows: int = 24_000, bits: int = 18, min_df: int = 1, min_chi2: float = 0.0, max_buckets: int = 256, pair_buckets: int = 16, steps: int = 2000, rank: int = 4, epochs: int = 25, rate: float = 0.03, decay: float = 0.01, pair_decay: float = 0.5, seed: int = 7
) -> Machine:
    """Fit to at most ``max_rows`` labelled rows; ``max_buckets`` and ``pair_buckets`` bound the model."""
    spark = documents.sparkSession
    sample = train_rows(labels, max_rows)  # bounded, so that broadcasting it is safe
    docs = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def make():
        terms = Terms(bits)
        return lambda row: [(row[0], int(row[2]), terms.of_text(row[1]).tolist())]

    seen = materialize(map_rows(docs, make, "doc_id long, y int, buckets array<int>", limit=100), "toxic-terms")
    n, pos, ids = seen.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.count_distinct("doc_id")).first()
    if ids < n:  # rows that repeat a doc_id; without them the sample is bounded as it is
        old, seen = seen, materialize(seen.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("buckets").alias("buckets")), "toxic-terms")
        release(old)
        n, pos = seen.agg(F.count("*"), F.sum("y")).first()
    if not n or pos in (0, n):
        release(seen)
        share = min(max(pos / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Machine(float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0), np.empty((0, rank)), bits)
    a, c = F.col("pos").cast("double"), F.col("df").cast("double")
    chi2 = n * F.pow(a * n - c * pos, F.lit(2)) / (c * (n - c) * pos * (n - pos))
    grouped = seen.select(F.explode("buckets").alias("bucket"), "y").groupBy("bucket").agg(F.count("*").alias("df"), F.sum("y").alias("pos"))
    counts = materialize(grouped.where(c < n), "toxic-counts")  # 2**bits rows at most
    telling = counts.where(F.col("df") >= min_df).where((chi2 > 0) & (chi2 >= min_chi2)).orderBy(chi2.desc(), "bucket").limit(max_buckets)
    weighed = [r["bucket"] for r in telling.select("bucket").collect()]
    frequent = counts.where(~F.col("bucket").isin(weighed)).orderBy(F.desc("df"), "bucket").limit(pair_buckets)
    buckets = np.array(sorted(weighed + [r["bucket"] for r in frequent.select("bucket").collect()]), np.int64)
    alone = np.isin(buckets, weighed).astype(float)
    release(counts)

    def keep_make():
        wanted = buckets

        def each(row):
            at = np.searchsorted(wanted, np.array(row[1], np.int64))
            ok = [int(i) for i, b in zip(at, row[1], strict=True) if i < len(wanted) and wanted[i] == b]
            return [(row[0], row[2], ok)]

        return each

    kept = map_rows(seen.select("y", "buckets", "doc_id"), keep_make, "y int, doc_id long, at array<int>").collect()
    release(seen)
    kept.sort(key=lambda r: (r["doc_id"], r["y"], r["at"]))
    x, y = [np.array(r["at"], np.int64) for r in kept], np.array([r["y"] for r in kept], float)
    bias, linear, factors = fit_machine(x, y, len(buckets), rank, epochs, rate, decay, pair_decay, seed, alone, steps)
    return Machine(bias + float(np.log((n - pos) / pos)), buckets, linear, factors, bits)


def score(documents: DataFrame, machine: Machine, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every document and its score; no other column is looked at."""
    return _scored(documents, machine, columns).select("keys.*", "score")


def _scored(documents: DataFrame, machine: Machine, columns: tuple[str, ...]) -> DataFrame:
    """keys (a struct of ``columns``) and score."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(machine)
    keys = documents.select(F.struct(*columns).alias("keys"), "text")
    if "text" in columns:
        keys = documents.select(F.struct(*columns).alias("keys"), F.lit(None).cast("string").alias("text"))

    def make():
        m = shared.value
        terms = Terms(m.bits, m.buckets)

        def each(row):
            text = row[0]["text"] if "text" in row[0] else row[1]
            return [(row[0], m.score(terms.of_text(text)))]

        return each

    schema = keys.select("keys").schema.add("score", "double")
    return map_rows(keys, make, schema)


def report(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on)."""
    scored = score(documents, fit(documents, labels, **options))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns."""
    scored = _scored(documents, fit(documents, labels, **options), tuple(documents.columns))
    return scored.where(F.col("score") < threshold).select("keys.*")
