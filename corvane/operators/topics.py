"""Topics learnt by expectation-maximisation over term counts, in DataFrame steps.

The model is a mixture of unigrams: a document has one topic, drawn by the topics'
shares, and its words are drawn from the topic's distribution. The counts are packed
once: a document is a row of term numbers and counts, kept where its key puts it. Of
the terms that several documents hold the ``TABLE`` most frequent at most are numbered. A round
reads the packed rows once: with the numbered terms' log probabilities as a matrix, a
task finds its documents' topic probabilities and sums its own counts with these
as weights, so what is shuffled is a row a task and numbered term. A term of one document has the
probabilities that follow from this document, which a round carries along. Only the
terms in between are joined, by term and by document.

Start and every sum are the same on each run: the first probabilities follow from a
hash of doc_id and seed, weighted counts are sums of whole numbers, and what decides is
rounded. Each round's tables are written, and those of the round before are deleted. The
driver holds the matrix, of ``TABLE`` rows at most, and ``k`` shares and totals a round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import import_path, materialize, release
from .ranking import terms_of, tokenised

#: Weight of a word that a topic has not seen, in words.
SMOOTHING = 0.1
#: Numbered terms (32 MB of log probabilities for 8 topics); counts that a task packs.
TABLE, PACK = 1 << 19, 20_000_000
#: Probabilities are whole numbers of this part.
UNIT = 1_000_000
#: Rows that a task holds to pack them, and gives back at once.
ROWS = 1 << 17


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, term and n of every document's words; a scratch table.

    A document is counted where it is read; of rows that share a doc_id each is counted on its own.
    """
    toks = tokenised(docs.where("doc_id is not null")).select("doc_id", "toks")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("term", StringType()), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            words = batch.column(1).flatten().dictionary_encode()
            if not len(words):
                continue
            size = len(words.dictionary)
            pairs, n = np.unique(pc.list_parent_indices(batch.column(1)).to_numpy().astype(np.int64) * size + words.indices.to_numpy(), return_counts=True)
            for at in range(0, len(pairs), ROWS):
                row, term = np.divmod(pairs[at : at + ROWS], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.dictionary.take(pa.array(term)), pa.array(n[at : at + ROWS])], schema=arrow)

    return materialize(toks.mapInArrow(run, schema), "topic-counts")


@dataclass(frozen=True)
class Packed:
    """Term counts by document.

    ``docs`` has doc_id, words, ids and ns (numbered terms and their counts, four bytes each), ``names`` id and term of
    these, ``rest`` doc_id, term, n and df of the other terms; ``n_names`` and ``n_terms`` count
    numbered and all terms.
    """

    docs: DataFrame
    names: DataFrame
    rest: DataFrame
    n_names: int
    n_terms: int

    def release(self) -> None:
        self.docs.unpersist()
        release(self.names)
        release(self.rest)


def pack(counts: DataFrame, table: int = TABLE) -> Packed:
    """Term counts (doc_id, term, n), packed; at most ``table`` terms are numbered, those that the most documents hold."""
    spark = counts.sparkSession
    dfs = materialize(counts.groupBy("term").agg(F.count("*").alias("df")), "topic-terms")
    sizes = dfs.groupBy("df").agg(F.count("*").alias("terms"))
    above = sizes.select("df", "terms", F.sum("terms").over(Window.orderBy(F.desc("df"))).alias("so_far"))  # a row a frequency
    least = above.where((F.col("so_far") <= table) & (F.col("df") > 1)).agg(F.min("df")).first()[0] or 1 << 62
    n_terms, n_counts = dfs.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    numbered = dfs.where(F.col("df") >= least).select((F.row_number().over(Window.orderBy("term")) - 1).alias("id"), "term")  # at most ``table`` rows
    names = materialize(numbered, "topic-names")
    met = counts.join(F.broadcast(names), "term", "left")
    rest = materialize(met.where("id is null").select("doc_id", "term", "n").join(dfs.where(F.col("df") < least), "term").select("doc_id", "term", "n", "df"), "topic-rest")
    parts = max(spark.sparkContext.defaultParallelism, -(-n_counts // PACK))
    whole = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.aggregate(c, F.lit(b""), lambda a, x: F.concat(a, x)))
    each = _runs(met.select("doc_id", "id", "n")).repartition(parts, "doc_id").groupBy("doc_id")
    docs = each.agg(F.sum("words").alias("words"), F.collect_list("ids").alias("ids"), F.collect_list("ns").alias("ns"))
    docs = docs.select("doc_id", "words", whole("ids").alias("ids"), whole("ns").alias("ns")).persist(StorageLevel.MEMORY_AND_DISK)
    release(dfs)
    return Packed(docs, names, rest, names.count(), n_terms)


def _runs(rows: DataFrame) -> DataFrame:
    """doc_id, words, ids and ns of rows (doc_id, id, n) that follow each other; a document may have several runs."""
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("words", LongType()), StructField("ids", BinaryType()), StructField("ns", BinaryType())])
    arrow = to_arrow_schema(schema)

    def packed(held):
        table = pa.Table.from_batches(held)
        key, ids, n = (table.column(c).combine_chunks() for c in ("doc_id", "id", "n"))
        first = np.r_[0, np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1]
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        n, named = n.to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()[named]
        order = np.lexsort((ids, run[named]))
        ends = np.r_[0, np.cumsum(np.bincount(run[named], minlength=len(first)))].astype(np.int32) * 4
        data = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x[order].astype(np.int32).tobytes())]) for x in (ids, n[named])]
        return pa.RecordBatch.from_arrays([key.take(pa.array(first)), pa.array(np.add.reduceat(n, first)), *data], schema=arrow)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return rows.mapInArrow(run, schema)


def _numbers(column: pa.Array) -> np.ndarray:
    """The packed numbers of all rows."""
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else [0, 0]
    n = (bounds[-1] - bounds[0]) // 4
    return np.frombuffer(column.buffers()[2], np.int32, n, bounds[0]) if n else np.zeros(0, np.int32)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and n of the numbered terms of packed rows."""
    row = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column("ids")).to_numpy() // 4)
    return row, _numbers(batch.column("ids")), _numbers(batch.column("ns")).astype(float)


def _softmax(logs: np.ndarray) -> np.ndarray:
    """Probabilities of log weights (topics by rows), in whole parts of UNIT."""
    e = np.exp(logs - logs.max(0))
    return np.round(e / e.sum(0) * UNIT)


def _lists(columns: np.ndarray) -> pa.Array:
    """A matrix, topics by rows, as a list a row."""
    k, n = columns.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(columns.T).ravel()))


def _matrix(lists: pa.Array, k: int) -> np.ndarray:
    """Lists of ``k`` numbers as a matrix, topics by rows; null lists are zeros."""
    out = np.zeros((k, len(lists)))
    out[:, lists.is_valid().to_numpy(zero_copy_only=False)] = lists.drop_null().flatten().to_numpy().reshape(-1, k).T
    return out


def _sums(values: str, weight: Column, k: int, decimals: int | None = None) -> Column:
    """Element-wise sum of an array column times ``weight``."""
    parts = [F.sum(F.get(values, F.lit(i)) * weight) for i in range(k)]
    return F.array(*(parts if decimals is None else [F.round(p, decimals) for p in parts]))


def _table(rows: DataFrame, size: int, k: int) -> np.ndarray:
    """id and an array of ``k`` numbers as a matrix, topics by rows; ids without a row are zeros."""
    got = rows.toArrow()
    out = np.zeros((k, size))
    if got.num_rows:
        out[:, got.column(0).to_numpy()] = _matrix(got.column(1).combine_chunks(), k)
    return out


def _beside(docs: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """The packed rows stay where they are, the smaller rows go to them."""
    return docs.join(other.hint("shuffle_hash"), "doc_id", how)


def _prior(shares: list[float]) -> np.ndarray:
    return np.array([math.log(max(p, 1e-12)) for p in shares])[:, None]


def _likely(packed: Packed, model: DataFrame, shares: list[float]) -> DataFrame:
    """doc_id, words and logs: log of share times probability of the document's words, by topic."""
    spark, k = packed.docs.sparkSession, len(shares)
    import_path(spark)
    unseen = F.array(*map(F.lit, model.where("term = ''").first()["lp"]))
    lp = _table(packed.names.join(model, "term", "left").select("id", F.coalesce("lp", unseen).alias("lp")), packed.n_names, k)
    others = packed.rest.join(model, "term", "left").select("doc_id", "n", F.coalesce("lp", unseen).alias("lp"))
    more = others.groupBy("doc_id").agg(_sums("lp", F.col("n"), k).alias("s"))
    shared = spark.sparkContext.broadcast((lp, _prior(shares)))
    schema = StructType([packed.docs.schema["doc_id"], packed.docs.schema["words"], StructField("logs", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        lp, prior = shared.value
        for batch in batches:
            row, ids, n = _entries(batch)
            s = _matrix(batch.column("s"), k)
            for i in range(k):
                s[i] += np.bincount(row, lp[i][ids] * n, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(np.round(s, 6) + prior).cast(arrow.field(2).type)], schema=arrow)

    return _beside(packed.docs, more, "left").select("doc_id", "words", "ids", "ns", "s").mapInArrow(run, schema)


def _round(packed: Packed, given: DataFrame, more: DataFrame | None, known: tuple | None, k: int) -> DataFrame:
    """The documents' next probabilities (doc_id, v and what a round carries along) and the weighted counts of each task (id and v).

    ``known`` has the numbered terms' log probabilities, the logs of the totals, the shares and the part
    that ``given`` counts in; without it the probabilities stay as they are. ``more``
    has the sums of the joined terms.
    """
    spark, size = packed.docs.sparkSession, packed.n_names
    import_path(spark)
    shared = spark.sparkContext.broadcast(known)
    key = packed.docs.schema["doc_id"]
    schema = StructType([StructField("doc_id", key.dataType), StructField("id", IntegerType()), StructField("v", ArrayType(DoubleType())), packed.docs.schema["words"], given.schema["alone"]])
    arrow = to_arrow_schema(schema)
    rows = _beside(packed.docs, given)
    rows = rows.withColumn("s", F.lit(None).cast("array<double>")) if more is None else _beside(rows, more, "left")

    def run(batches):
        c = np.zeros((k, size))
        for batch in batches:
            n_rows = batch.num_rows
            row, ids, n = _entries(batch)
            p = _matrix(batch.column("p"), k)
            if shared.value is not None:
                lp, totals, prior, part = shared.value
                s, alone = _matrix(batch.column("s"), k), batch.column("alone")
                mine = pc.list_parent_indices(alone).to_numpy()
                own = alone.flatten().to_numpy().astype(float)
                for i in range(k):
                    s[i] += np.bincount(row, lp[i][ids] * n, n_rows)
                    s[i] += np.bincount(mine, own * (np.log(own * p[i][mine] / part + SMOOTHING) - totals[i]), n_rows)
                p = _softmax(np.round(s, 6) + prior)
            for i in range(k if size else 0):
                c[i] += np.bincount(ids, p[i][row] * n, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(n_rows, pa.int32()), _lists(p).cast(arrow.field(2).type), batch.column("words"), batch.column("alone")], schema=arrow)
        held = np.flatnonzero(c.any(0))
        for at in range(0, len(held), 1 << 14):
            ids = held[at : at + (1 << 14)]
            none = [pa.nulls(len(ids), arrow.field(x).type) for x in ("doc_id", "words", "alone")]
            yield pa.RecordBatch.from_arrays([none[0], pa.array(ids, pa.int32()), _lists(c[:, ids]).cast(arrow.field(2).type), none[1], none[2]], schema=arrow)

    return rows.select("doc_id", "words", "ids", "ns", "p", "alone", "s").mapInArrow(run, schema)


def fit(counts: DataFrame | Packed, k: int, rounds: int = 8, seed: int = 11) -> tuple[DataFrame, list[float]]:
    """(term and lp, log probabilities by topic; the topics' shares) from term counts, packed or not.

    The first probabilities lean, by a hash, to one topic in two to one. The model
    has a row for the empty term: a word that no counted document holds.
    """
    packed = counts if isinstance(counts, Packed) else pack(counts)
    spark = packed.docs.sparkSession
    lean = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(k))
    start = F.array(*[F.when(lean == i, F.lit(2.0)).otherwise(F.lit(1.0)) for i in range(k)])
    single = packed.rest.where("df = 1")
    alone = single.groupBy("doc_id").agg(F.sort_array(F.collect_list("n")).alias("alone"))
    begun = packed.docs.select("doc_id").join(alone, "doc_id", "left")
    given = materialize(begun.select("doc_id", start.alias("p"), F.coalesce("alone", F.array().cast("array<bigint>")).alias("alone")), "topic-given")
    part, size, known, more, old = k + 1, packed.n_terms + 1, None, None, given
    shared = packed.rest.where("df > 1")
    joined = bool(shared.limit(1).count())
    for turn in range(rounds + 1):
        now = materialize(_round(packed, given, more, known, k), "topic-round")
        part = part if known is None else UNIT
        given = now.where("id is null").select("doc_id", F.col("v").alias("p"), "words", "alone")
        weighted = now.where("id is not null").groupBy("id").agg(_sums("v", F.lit(1), k).alias("c"))
        mass = given.agg(_sums("p", F.lit(1), k).alias("m"), _sums("p", F.col("words"), k).alias("t"), F.count("*").alias("n")).first()
        shares = [round((x or 0.0) / part, 3) / max(1, mass["n"]) for x in mass["m"]]
        totals = [math.log((x or 0.0) / part + SMOOTHING * size) for x in mass["t"]]
        given = given.drop("words")
        log = lambda c: F.transform(c, lambda x, i: F.log(x / F.lit(float(part)) + SMOOTHING) - F.get(F.array(*map(F.lit, totals)), i))  # noqa: B023, E731
        between = None
        if joined:
            between = materialize(shared.join(given.select("doc_id", "p"), "doc_id").groupBy("term").agg(_sums("p", F.col("n"), k).alias("c")).select("term", log("c").alias("lp")), "topic-between")
        if turn == rounds:
            break
        logs = np.log(_table(weighted, packed.n_names, k) / part + SMOOTHING) - np.array(totals)[:, None]
        known = (logs, totals, _prior(shares), part)
        fresh = None
        if joined:
            fresh = materialize(shared.join(between, "term").groupBy("doc_id").agg(_sums("lp", F.col("n"), k).alias("s")), "topic-sums")
            release(between)
        for table in (old, more):
            if table is not None:
                release(table)
        old, more = now, fresh
    named = weighted.join(F.broadcast(packed.names), "id").select("term", log("c").alias("lp"))
    ones = single.join(given.select("doc_id", "p"), "doc_id").select("term", log(F.transform("p", lambda x: x * F.col("n"))).alias("lp"))
    empty = spark.range(1).select(F.lit("").alias("term"), log(F.array(*[F.lit(0.0)] * k)).alias("lp"))
    model = named.unionAll(ones).unionAll(empty)
    model = materialize(model if between is None else model.unionAll(between), "topic-model")
    for table in (old, more, between, now):
        if table is not None:
            release(table)
    if packed is not counts:
        packed.release()
    return model, shares


def assign(counts: DataFrame | Packed, model: DataFrame, shares: list[float]) -> DataFrame:
    """doc_id, topic (most probable, the first of equal ones) and its probability."""
    packed = counts if isinstance(counts, Packed) else pack(counts)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    e = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    p = _likely(packed, model, shares).select("doc_id", e.alias("e")).select("doc_id", F.transform("e", lambda x: F.round(x / total(F.col("e")), 6)).alias("p"))
    return p.select("doc_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("topic"), F.array_max("p").alias("probability"))


def perplexity(counts: DataFrame | Packed, model: DataFrame, shares: list[float]) -> DataFrame:
    """n_words and perplexity of documents under the mixture."""
    logs = _likely(counts if isinstance(counts, Packed) else pack(counts), model, shares)
    top = F.array_max("logs")
    total = F.aggregate(F.transform("logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return logs.select("words", (F.log(total) + top).alias("l")).agg(F.sum("words").alias("n_words"), F.exp(-F.sum("l") / F.sum("words")).alias("perplexity"))
