"""A positional inverted index: phrases, words near each other, weighted places.

One row a document and term: ``gaps`` are the term's positions, each as the
distance to the one before (the first to 0), so that frequent terms are small
numbers; ``labels`` holds a letter a position, A to D, for the part of the document
it comes from (title, text). Positions are counted from 1 over all parts.

A search starts from the postings of each query's rarest word. Only for these
documents the other words' postings are joined, by document and term, so that the
work follows the rare words and a word of every document costs one shuffle of its
postings, whatever the number of queries that hold it. A phrase is then found by
intersection: the positions of its words, each moved back by the word's place in
the phrase, must meet. Arrays of positions are bounded by their document.

Defined results: null texts have no positions; a query without words, or with a
word that no document holds, finds nothing; rows that share a doc_id are numbered
apart (``row``), so their positions don't mix, and both answer; a null doc_id is
found like any other. ``query_id`` has to be unique.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import document_tokens
from ..session import import_path, materialize, spread
from . import ranking
from .ranking import document_frequency, ranked, small

#: Weights of the labels.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
#: Documents whose words are put in order at once.
STEP = 64


def gaps_of(positions: Column) -> Column:
    """Ascending positions as differences, the first as it is."""
    before = F.concat(F.array(F.lit(0)), F.slice(positions, 1, F.greatest(F.size(positions) - 1, F.lit(0))))
    return F.zip_with(positions, before, lambda a, b: a - b)


def positions_of(gaps: Column, labels: Column, only: str | None = None) -> Column:
    """The positions that :func:`gaps_of` was given, those with a label of ``only``.

    A running sum over an array takes quadratic time in higher-order functions,
    hence NumPy.
    """
    kept = np.array(sorted(only.encode()), np.uint8) if only else None

    @F.pandas_udf("array<int>")
    def sums(gaps: pd.Series, labels: pd.Series) -> pd.Series:
        at = [np.cumsum(g, dtype=np.int32) for g in gaps]
        if kept is not None:
            at = [a[np.isin(np.frombuffer(x.encode(), np.uint8), kept)] for a, x in zip(at, labels, strict=True)]
        return pd.Series(at, dtype=object)

    return sums(gaps, labels)


def index_positions(docs: DataFrame, parts: dict[str, str] | None = None) -> DataFrame:
    """row, doc_id, term, gaps and labels, a scratch table; ``parts`` maps columns, in order, to labels.

    A document's postings follow from its row alone, so no word is shuffled.
    """
    parts = parts or {"text": "D"}
    if not set(parts.values()) <= set(WEIGHTS):
        raise ValueError(f"labels are {', '.join(WEIGHTS)}")

    import_path(docs.sparkSession)
    key = docs.schema["doc_id"].dataType
    schema = StructType([StructField("row", LongType()), StructField("doc_id", key), StructField("term", StringType()), StructField("gaps", ArrayType(IntegerType())), StructField("labels", StringType())])
    arrow, letters = to_arrow_schema(schema), "".join(parts.values())
    rows = spread(docs.select("doc_id", *parts)).select(F.monotonically_increasing_id().alias("row"), "doc_id", *[document_tokens(F.col(c)).alias(f"part{i}") for i, c in enumerate(parts)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                yield _posted(batch.slice(at, STEP), letters, arrow)

    return materialize(rows.mapInArrow(run, schema), "index")  # rows keep their numbers


def _posted(rows: pa.RecordBatch, letters: str, schema: pa.Schema) -> pa.RecordBatch:
    """The postings of whole documents (row, doc_id and the tokens of each part), which need no other rows."""
    sizes = np.array([pc.list_value_length(c).to_numpy() for c in rows.columns[2:]], np.int64)
    tokens = pa.chunked_array([c.flatten() for c in rows.columns[2:]]).combine_chunks().dictionary_encode()
    n = rows.num_rows
    owner = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
    label = np.repeat(np.frombuffer(letters.encode(), np.uint8), sizes.sum(1))
    before = np.cumsum(sizes, 0) - sizes  # words of the document in earlier parts
    at = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(b, s) for s, b in zip(sizes, before, strict=True)]) + 1
    code = tokens.indices.to_numpy()
    order = np.lexsort((at, code, owner))
    owner, code, at, label = owner[order], code[order], at[order], label[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    starts = np.flatnonzero(new)
    gaps = np.where(new, at, at - np.concatenate(([0], at[:-1])))
    edges = pa.array(np.append(starts, len(at)).astype(np.int32))
    own = pa.array(owner[starts])
    marks = pa.StringArray.from_buffers(len(starts), edges.buffers()[1], pa.py_buffer(label.tobytes()))
    columns = [rows.column(0).take(own), rows.column(1).take(own), tokens.dictionary.take(pa.array(code[starts])), pa.ListArray.from_arrays(edges, pa.array(gaps.astype(np.int32))), marks]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, term, its places in the query (from 0) and the query's number of different terms; a scratch table."""
    toks = queries.select("query_id", document_tokens(F.col("query")).alias("toks"))
    each = toks.select("query_id", F.size(F.array_distinct("toks")).alias("different"), F.posexplode_outer("toks").alias("place", "term")).where("term is not null")
    return materialize(each.groupBy("query_id", "different", "term").agg(F.sort_array(F.collect_list("place")).alias("places")), "query-words")


def documents_with_all(index: DataFrame, queries: DataFrame, only: str | None = None) -> DataFrame:
    """query_id, doc_id and words (places in the query, positions at) of documents that hold all words of a query."""
    import_path(index.sparkSession)
    asked = query_words(queries)
    post = index.join(small(asked.select("term").distinct()), "term", "left_semi")
    df = document_frequency(post)
    # a word of no document comes first and finds none
    rarest = asked.join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select("query_id", "r.term")
    starts = post.select("row", "term").join(small(rarest), "term").select("query_id", "row")
    wanted = starts.join(small(asked), "query_id")
    met = wanted.join(post, ["row", "term"]).select("query_id", "row", "doc_id", "different", "places", positions_of(F.col("gaps"), F.col("labels"), only).alias("at"))
    words = F.sort_array(F.collect_list(F.struct("places", "at")))
    return met.where(F.size("at") > 0).groupBy("query_id", "row", "doc_id", "different").agg(words.alias("words")).where(F.size("words") == F.col("different")).select("query_id", "doc_id", "words")


def phrase_search(index: DataFrame, queries: DataFrame, only: str | None = None) -> DataFrame:
    """query_id, doc_id, n (occurrences) and first (position) of queries (query_id, query) as phrases.

    ``only``, such as "A" or "AB", has all words of an occurrence in these parts.
    """
    met = documents_with_all(index, queries, only)
    moved = F.flatten(F.transform("words", lambda w: F.transform(w["places"], lambda p: F.transform(w["at"], lambda a: a - p))))
    lists = met.select("query_id", "doc_id", moved.alias("lists"))
    common = F.aggregate("lists", F.element_at("lists", 1), lambda acc, x: F.array_intersect(acc, x))
    found = lists.select("query_id", "doc_id", common.alias("at")).where(F.size("at") > 0)
    return found.select("query_id", "doc_id", F.size("at").alias("n"), F.array_min("at").alias("first"))


def near_search(index: DataFrame, queries: DataFrame, width: int, only: str | None = None) -> DataFrame:
    """query_id, doc_id and span: the fewest positions in a row that hold all words of the query, up to ``width``."""
    met = documents_with_all(index, queries, only)
    each = F.transform("words", lambda w, i: F.transform(w["at"], lambda a: F.struct(a.alias("at"), i.alias("word"))))
    merged = met.select("query_id", "doc_id", F.array_sort(F.flatten(each)).alias("all"), F.transform("words", lambda w: F.lit(0)).alias("last"))
    start = F.struct("last", F.lit(None).cast("int").alias("span"))

    def step(acc, e):
        last = F.transform(acc["last"], lambda x, i: F.when(i == e["word"], e["at"]).otherwise(x))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low > 0, F.least(acc["span"], e["at"] - low + 1)).otherwise(acc["span"]).alias("span"))

    found = merged.select("query_id", "doc_id", F.aggregate("all", start, step, lambda acc: acc["span"]).alias("span"))
    return found.where(F.col("span") <= width)


def weighted_search(index: DataFrame, queries: DataFrame, k: int, weights: dict[str, float] | None = None, decimals: int | None = None) -> DataFrame:
    """query_id, doc_id, score and rank: occurrences of the query's words, each by the weight of its label."""
    weights = WEIGHTS | (weights or {})
    asked = query_words(queries)
    count = lambda label: F.length("labels") - F.length(F.replace("labels", F.lit(label)))
    part = sum((count(label) * float(w) for label, w in weights.items()), F.lit(0.0))
    post = index.select("row", "doc_id", "term", part.alias("part")).join(small(asked.select("term").distinct()), "term", "left_semi")
    words = asked.select("query_id", "term")
    met = words.join(document_frequency(post), "term").agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    if met[0] <= ranking.BROADCAST_ROWS:  # pairs are made and summed in the task that has the document
        cores = index.sparkSession.sparkContext.defaultParallelism
        pairs = post.repartition(max(cores, -(-met[1] // ranking.PAIRS)), "row").join(F.broadcast(words), "term")
    else:
        pairs = post.join(words, "term")
    scored = pairs.groupBy("query_id", "row", "doc_id").agg(F.sum("part").alias("score"))
    scored = scored if decimals is None else scored.withColumn("score", F.round("score", decimals))
    return ranked(scored.where("score > 0").drop("row"), [F.desc("score"), F.col("doc_id")], k)
