"""Ranked lexical search by branch-and-bound over max trees.

The documents of a task are taken in ranges of up to ``RANGE`` rows. For every
term a range has a tree over its documents: a leaf is the term's impact in one
document, a node the largest impact among ``FAN`` children, and only nodes that
hold the term exist. All terms' nodes of a level lie in one array, ordered by
node, so that a node's children are a slice.

The bound of a node for an item is the sum of the item's weights times the terms'
maxima there. Search takes the node of the highest bound from a heap, opens it,
and pushes its children, until the highest bound is under the score of the k-th
best document; nodes whose bound equals that score are opened, too, as they may
hold a tie with a smaller doc_id. The best documents of an item go along from
range to range of a task, so later ranges are cut by earlier ones. Each task
returns k rows an item at most, exact for its documents; a window merges them.

Documents are tokenised once, and only counts of terms that items hold are
written (``postings``); the collection's figures come from that table. Items are
read to the driver in blocks of some ``block_words`` words, which bounds the
vocabulary, the weights and the heaps of a task; each block is one pass.

Defined results: null or empty texts have no terms, are no documents of the
collection and never found; an item without terms, or with terms of no document,
has no rows; a repeated item is answered once a row; rows that share a doc_id are
documents of their own; equal scores are ordered by doc_id, null ones last.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import materialize, release, spread
from .arrowio import batched, map_arrow, map_rows, rows_of
from .words import letter_words

RANGE, FAN_BITS, MOST_POSTINGS = 4096, 4, 2_000_000
_LAST = 1 << 63


def postings(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms with repeats), terms (numbers of wanted ones) and tfs of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(numbers)

    def make():
        get = shared.value.get

        def each(row):
            words = letter_words(row[1])
            found = sorted((get(w), c) for w, c in Counter(words).items() if w in shared.value)
            yield row[0], len(words), [t for t, _ in found], [c for _, c in found]

        return each

    docs = spread(documents.select(F.col("doc_id").cast("long"), "text"))
    return map_rows(docs, make, "doc_id long, n long, terms array<int>, tfs array<long>")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The length term m of documents with ``n`` terms."""
    different, back = np.unique(n, return_inverse=True)
    return np.array([75 + (25 * int(x) * documents) // total for x in different], np.int64)[back]


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class MaxTree:
    """Trees of all terms over one range of documents, level by level from the documents up."""

    def __init__(self, count: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        self.levels = []
        node, nodes = doc, count
        while True:
            self.levels.append((term, value, np.searchsorted(node, np.arange(nodes + 1))))
            if nodes <= 1:
                break
            node, nodes = node >> FAN_BITS, ((nodes - 1) >> FAN_BITS) + 1
            order = np.lexsort((term, node))
            node, term, value = node[order], term[order], value[order]
            head = np.flatnonzero(np.concatenate((np.ones(min(1, len(node)), bool), (node[1:] != node[:-1]) | (term[1:] != term[:-1]))))
            value = np.maximum.reduceat(value, head) if len(head) else value
            node, term = node[head], term[head]

    def open(self, level: int, node: int, weights: np.ndarray) -> tuple[int, np.ndarray]:
        """First child of a node of ``level`` and the bounds of its children (scores, above documents)."""
        term, value, edges = self.levels[level - 1]
        first = node << FAN_BITS
        edge = edges[first : first + (1 << FAN_BITS) + 1]
        a, b = edge[0], edge[-1]
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(weights[term[a:b]] * value[a:b])))
        return first, sums[edge[1:] - a] - sums[edge[:-1] - a]


def best_first(tree: MaxTree, ids: list, weights: np.ndarray, best: list, k: int) -> None:
    """Brings ``best``, a heap of the k best (score, -doc_id, doc_id), up to date with a range."""
    top = len(tree.levels) - 1
    if top == 0:  # one document
        term, value, _ = tree.levels[0]
        found = [(0, int((weights[term] * value).sum()))]
        heap = []
    else:
        found, heap = [], [(-_LAST, top, 0)]
    while heap or found:
        for place, score in found:
            doc_id = ids[place]
            entry = (score, -_LAST if doc_id is None else -doc_id, doc_id is not None)
            if score > 0 and (len(best) < k or entry > best[0]):
                (heapq.heappush if len(best) < k else heapq.heapreplace)(best, entry)
        found = []
        least = best[0][0] if len(best) == k else 1
        if not heap or -heap[0][0] < least:
            return
        _, level, node = heapq.heappop(heap)
        first, bounds = tree.open(level, node, weights)
        for i in np.flatnonzero(bounds >= least).tolist():
            if level == 1:
                found.append((first + i, int(bounds[i])))
            else:
                heapq.heappush(heap, (-int(bounds[i]), level - 1, first + i))


def ranges(rows, size: int = RANGE, most: int = MOST_POSTINGS):
    """Lists of rows: ``size`` at most, fewer where their postings reach ``most``."""
    held, load = [], 0
    for row in rows:
        if not row[2]:
            continue
        held.append(row)
        load += len(row[2])
        if len(held) == size or load >= most:
            yield held
            held, load = [], 0
    if held:
        yield held


def tree_of(rows: list[tuple], documents: int, total: int) -> MaxTree:
    sizes = [len(r[2]) for r in rows]
    doc = np.repeat(np.arange(len(rows)), sizes)
    term = np.array([t for r in rows for t in r[2]], np.int64)
    tf = np.array([c for r in rows for c in r[3]], np.int64)
    m = lengths(np.array([r[1] for r in rows], np.int64), documents, total)
    return MaxTree(len(rows), doc, term, impact(tf, m[doc]))


def search(documents: DataFrame, items: DataFrame, k: int = 20, block_words: int = 200_000) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of every row of ``items``."""
    spark = documents.sparkSession
    items = items.select("item_id", "text")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = items.agg(F.sum(F.regexp_count(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-count // block_words))
    item_type = items.schema["item_id"].dataType
    schema = StructType([StructField("item", IntegerType()), StructField("item_id", item_type), StructField("doc_id", LongType()), StructField("score", LongType())])
    out = None
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        asked = [(r.item_id, Counter(letter_words(r.text))) for r in mine.collect()]
        numbers: dict[bytes, int] = {}
        for _, words in asked:
            for w in words:
                numbers.setdefault(w, len(numbers))
        table = materialize(postings(documents, numbers), "lexical-postings")
        n, total = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        asked = [(item_id, [(numbers[w], c * weight(n, df[numbers[w]])) for w, c in words.items() if numbers[w] in df]) for item_id, words in asked]
        found = _found(table, asked, len(numbers), n, total, k, schema)
        if blocks > 1:
            found = materialize(found.where(F.col("rank") <= k), f"lexical-{block}")
            release(table)
        out = found if out is None else out.unionAll(found)
    return out.select("item_id", "rank", "doc_id", "score")


def _found(table: DataFrame, asked: list[tuple], width: int, n: int, total: int, k: int, schema: StructType) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(asked)
    arrow = to_arrow_schema(schema)

    def best_rows(batches):
        best = [[] for _ in shared.value]
        for rows in ranges(rows_of(batches)):
            tree, ids = tree_of(rows, n, total), [r[0] for r in rows]
            weights = np.zeros(width, np.int64)
            for (_, terms), heap in zip(shared.value, best, strict=True):
                for t, w in terms:
                    weights[t] = w
                best_first(tree, ids, weights, heap, k)
                for t, _ in terms:
                    weights[t] = 0
        for i, ((item_id, _), heap) in enumerate(zip(shared.value, best, strict=True)):
            yield from ((i, item_id, -minus if known else None, score) for score, minus, known in heap)

    found = map_arrow(table, lambda batches: batched(best_rows(batches), arrow), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sql(k: int = 20) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM (SELECT doc_id, {words} AS w FROM documents)
), q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({words}) AS term FROM benchmark) GROUP BY ALL
), p AS MATERIALIZED (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), st AS (
  SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st
), s AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), st GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}
"""
