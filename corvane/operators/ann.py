"""Approximate nearest vectors by cosine: inverted cells and product-quantised residuals.

A quantiser is fitted to a bounded sample (``SAMPLE_BYTES`` of vectors, chosen by
hash): k-means gives the centres of cells, and for each of ``parts`` slices of the
dimensions k-means over the residuals gives 256 codewords. Every vector is indexed:
Spark assigns it to the nearest cell and writes it as one byte a slice, in blocks of
up to ``BLOCK`` vectors of one cell, in a table partitioned by cell. A cell that
holds many vectors has many blocks, so no task is bound to a cell.

A search probes the ``probes`` cells with the nearest centres of each query; by
default as many as, within the sample, hold ``TARGET`` of the ten nearest vectors of
sample vectors, so vectors without clusters get more probes than clustered ones. Blocks
of codes meet blocks of queries by a join on the cell; a task scores a pair of
blocks with table lookups, and the best ``shortlist`` candidates of a query are
scored again by their vectors. That last step is exact, so only candidates can be
missed; :func:`recall` measures how many are. The exact way for all rows is
``ranking.dense_topk``, and ``probes`` of at least the number of cells with a
shortlist of all rows gives the same.

Defined results: vectors without direction (null, all zero, not finite) or with
another number of dimensions are indexed in cell -1, which is never probed, as
exact search leaves them out, too; rows that share a doc_id are rows of their own;
equal scores are ordered by doc_id; a doc_id that is null is not found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import dot, norm
from ..session import import_path, materialize, spread
from ..sources.versions import Versions
from .ranking import ranked, small

SAMPLE_BYTES, SAMPLE_ROWS = 64 << 20, 65_536
BLOCK, QUERY_BLOCK = 4096, 256
#: Estimates that a task makes, and candidates that it holds.
PAIRS, HELD = 4_000_000, 1 << 20
SHORTLIST, TARGET = 200, 0.98
CODES, QUANTISER = "codes", "quantiser"


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``k`` groups of rows, by Lloyd's rounds from distinct random rows; empty groups keep theirs."""
    start = np.unique(x, axis=0)
    centres = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        own = nearest_rows(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the number of its nearest centre."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + BLOCK] @ centres.T - half, 1) for i in range(0, len(x), BLOCK)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Quantiser:
    """Centres of cells, and the codewords of each slice of the dimensions."""

    cells: np.ndarray
    books: tuple[np.ndarray, ...]

    @property
    def bounds(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (a byte a slice) of unit vectors."""
        cell = nearest_rows(unit, self.cells)
        rest = unit - self.cells[cell]
        at = self.bounds
        return cell, np.stack([nearest_rows(rest[:, at[i] : at[i + 1]], b) for i, b in enumerate(self.books)], 1).astype(np.uint8)

    def score(self, queries: np.ndarray, base: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of each query with each coded vector of a cell; ``base`` is that with its centre."""
        out = np.repeat(base[:, None], len(codes), 1)
        at = self.bounds
        for i, book in enumerate(self.books):
            out += (queries[:, at[i] : at[i + 1]] @ book.T)[:, codes[:, i]]
        return out

    def rows(self) -> list[tuple]:
        """(kind, number, values): cells as kind -1, codewords by slice."""
        return [(kind, i, row.tolist()) for kind, table in [(-1, self.cells), *enumerate(self.books)] for i, row in enumerate(table)]

    @staticmethod
    def of_rows(rows: list) -> Quantiser:
        tables: dict[int, list] = {}
        for kind, _, values in sorted(tuple(r) for r in rows):
            tables.setdefault(kind, []).append(values)
        return Quantiser(np.array(tables[-1], float), tuple(np.array(tables[i], float) for i in range(len(tables) - 1)))


def _usable(v: Column, dim: int) -> Column:
    return F.coalesce((F.size(v) == dim) & (norm(v) > 0) & (norm(v) < float("inf")), F.lit(False))


def _unit(v: Column, dim: int) -> Column:
    # the norm is the lambda's argument, as inside of the inner one it would be taken for every number
    divided = F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))
    return F.when(_usable(v, dim), divided)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def probes_for(x: np.ndarray, centres: np.ndarray, target: float = TARGET, k: int = 10, most: int = 256) -> int:
    """Cells to probe so that ``target`` of the ``k`` nearest rows of up to ``most`` rows of ``x`` are in them."""
    q = x[:most]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centres)
    found = np.argpartition(-near, k - 1, 1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), 1), 1)
    needed = np.sort(np.take_along_axis(place, nearest_rows(x, centres)[found], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def fit(vectors: DataFrame, cells: int | None = None, parts: int = 16, seed: int = 7, rounds: int = 12) -> tuple[Quantiser, int]:
    """A quantiser of vectors (doc_id, vector) and the cells to probe, from a sample of at most SAMPLE_ROWS rows and SAMPLE_BYTES.

    By default there are twice as many cells as the square root of the rows, but no
    more than one for 32 rows of the sample.
    """
    n, dim = vectors.agg(F.count("*"), F.mode(F.size("vector"))).first()
    if not dim or dim < 1:
        raise ValueError("no vectors to fit to")
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    drawn = vectors.where(_usable(F.col("vector"), dim)).orderBy(F.xxhash64("doc_id", "vector", F.lit(seed))).limit(most)
    x = _matrix(drawn.select(_unit(F.col("vector"), dim).alias("u")).toArrow().column("u").combine_chunks(), dim)
    rng = np.random.default_rng(seed)
    centres = kmeans(x, max(1, min(cells or round(2 * n**0.5), max(1, len(x) // 32))), rounds, rng)
    rest = x - centres[nearest_rows(x, centres)]
    slices = np.array_split(np.arange(dim), min(parts, dim))
    return Quantiser(centres, tuple(kmeans(rest[:, s], 256, rounds, rng) for s in slices)), probes_for(x, centres)


def _in_blocks(df: DataFrame, key: str, size: int, schema: StructType, pack) -> DataFrame:
    """Rows sorted by ``cell`` as blocks of up to ``size`` rows of one cell; ``pack`` makes the columns of a block."""
    arrow = to_arrow_schema(schema)
    ordered = df.repartitionByRange("cell", F.xxhash64(key)).sortWithinPartitions("cell")

    def run(batches):
        held, rows = [], 0

        def blocks():
            table = pa.Table.from_batches(held)
            cell = table.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, size):
                    part = table.slice(at, min(size, b - at)).combine_chunks()
                    yield pa.RecordBatch.from_pylist([{"cell": int(cell[a]), **pack(part)}], arrow)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= size:
                yield from blocks()
                held, rows = [], 0
        if rows:
            yield from blocks()

    return ordered.mapInArrow(run, schema)


def encode(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """cell, doc_ids and codes: every vector (doc_id, vector), in blocks of a cell."""
    import_path(vectors.sparkSession)
    dim, parts = quantiser.cells.shape[1], len(quantiser.books)
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)
    key = vectors.schema["doc_id"].dataType
    flat = StructType([StructField("doc_id", key), StructField("cell", IntegerType()), StructField("code", BinaryType())])
    arrow = to_arrow_schema(flat)

    def run(batches):
        for batch in batches:
            unit = batch.column(1)
            known = unit.is_valid().to_numpy(zero_copy_only=False)
            cell, code = np.full(len(known), -1, np.int32), np.zeros((len(known), parts), np.uint8)
            if known.any():
                cell[known], code[known] = shared.value.encode(_matrix(unit.drop_null(), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array([row.tobytes() for row in code], pa.binary())], schema=arrow)

    flatly = spread(vectors.select("doc_id", "vector")).select("doc_id", _unit(F.col("vector"), dim).alias("u")).mapInArrow(run, flat)
    schema = StructType([StructField("cell", IntegerType()), StructField("doc_ids", ArrayType(key)), StructField("codes", BinaryType())])
    pack = lambda part: {"doc_ids": part.column("doc_id").to_pylist(), "codes": b"".join(part.column("code").to_pylist())}
    return _in_blocks(flatly, "doc_id", BLOCK, schema, pack)


def build(vectors: DataFrame, root: str, cells: int | None = None, parts: int = 16, seed: int = 7, reset: bool = False) -> Versions:
    """Fit, index all rows and load quantiser and codes as one version of ``root``."""
    index = Versions(vectors.sparkSession, root)
    quantiser, probes = fit(vectors, cells, parts, seed)
    table = vectors.sparkSession.createDataFrame(quantiser.rows(), "kind int, number int, values array<double>")
    index.load({QUANTISER: table, CODES: encode(vectors, quantiser)}, reset, {"probes": probes}, {CODES: "cell"})
    return index


def _probed(queries: DataFrame, quantiser: Quantiser, probes: int) -> DataFrame:
    """cell, query_ids, bases and vectors: blocks of queries (query_id, vector) by the cells they probe."""
    dim = quantiser.cells.shape[1]
    shared = queries.sparkSession.sparkContext.broadcast(quantiser)
    key = queries.schema["query_id"].dataType
    flat = StructType([StructField("query_id", key), StructField("cell", IntegerType()), StructField("base", DoubleType()), StructField("u", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(flat)

    def run(batches):
        for batch in batches:
            unit = _matrix(batch.column(1), dim)
            near = unit @ shared.value.cells.T
            k = min(probes, near.shape[1])
            cell = np.argpartition(-near, k - 1, 1)[:, :k]
            base, rows = np.take_along_axis(near, cell, 1), np.repeat(np.arange(len(unit)), k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cell.ravel(), pa.int32()), pa.array(base.ravel()), batch.column(1).take(pa.array(rows)).cast(arrow.field("u").type)], schema=arrow)

    usable = queries.select("query_id", _unit(F.col("vector"), dim).alias("u")).where("u is not null")
    schema = StructType([StructField("cell", IntegerType()), StructField("query_ids", ArrayType(key)), StructField("bases", ArrayType(DoubleType())), StructField("units", ArrayType(DoubleType()))])
    pack = lambda part: {"query_ids": part.column("query_id").to_pylist(), "bases": part.column("base").to_pylist(), "units": part.column("u").combine_chunks().flatten().to_numpy().tolist()}
    return _in_blocks(usable.mapInArrow(run, flat), "query_id", QUERY_BLOCK, schema, pack)


def _heads(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each query, equal ones by doc, a null doc first as Spark sorts it."""
    order = np.lexsort((doc, -score, query))
    query = query[order]
    return order[np.arange(len(query)) - np.searchsorted(query, query) < k]


def _dealt(codes: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of codes with the blocks of queries that probe their cell, dealt by the estimates to make, not by bytes.

    A cell with more than ``PAIRS`` estimates goes to several tasks.
    """
    spark = codes.sparkSession
    each = [df.groupBy("cell").agg(F.sum(F.size(c)).alias(c)) for df, c in ((codes, "doc_ids"), (asked, "query_ids"))]
    load = each[0].join(each[1], "cell").select("cell", (F.col("doc_ids") * F.col("query_ids")).alias("pairs"))  # a row a cell
    load = materialize(load, "cells")
    pairs = load.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    share = F.broadcast(load.select("cell", F.ceil(F.col("pairs") / PAIRS).cast("int").alias("shares")))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))  # fewer would be shuffled again
    own = codes.join(share, "cell").withColumn("share", F.pmod(F.xxhash64("codes", "doc_ids"), F.col("shares")).cast("int"))
    met = asked.join(share, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return own.repartition(parts, "cell", "share").join(met.repartition(parts, "cell", "share").hint("merge"), ["cell", "share"])


def candidates(index: Versions, queries: DataFrame, probes: int | None = None, shortlist: int = SHORTLIST, state: dict | None = None) -> DataFrame:
    """query_id and doc_id of the best ``shortlist`` by estimated cosine in the probed cells."""
    import_path(index.spark)
    state = state or index.state()
    quantiser = Quantiser.of_rows(index.read(QUANTISER, state).collect())  # bounded by the sample
    shared = index.spark.sparkContext.broadcast(quantiser)
    dim, parts = quantiser.cells.shape[1], len(quantiser.books)
    codes = index.read(CODES, state)
    asked = materialize(_probed(queries, quantiser, probes or state["facts"]["probes"]), "probes")
    met = _dealt(codes, asked).select("query_ids", "bases", "units", "doc_ids", "codes")
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", codes.schema["doc_ids"].dataType.elementType), StructField("estimate", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, rows = [], 0

        def best():
            table = pa.Table.from_batches(held).combine_chunks()
            query = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
            doc = pc.rank(table.column(1), "ascending", null_placement="at_start").to_numpy()
            return table.take(pa.array(_heads(query, doc, table.column(2).to_numpy(), shortlist))).to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                code = np.frombuffer(one.column(4)[0].as_py(), np.uint8).reshape(-1, parts)
                scores = shared.value.score(_matrix(one.column(2), dim), one.column(1).flatten().to_numpy(), code)
                k = min(shortlist, len(code))
                first = np.argpartition(-scores, k - 1, 1)[:, :k]
                asked_ids, ids = one.column(0).flatten(), one.column(3).flatten()
                places = np.repeat(np.arange(len(asked_ids)), k)
                held.append(pa.RecordBatch.from_arrays([asked_ids.take(pa.array(places)), ids.take(pa.array(first.ravel())), pa.array(np.take_along_axis(scores, first, 1).ravel())], schema=arrow))
                rows += len(places)
                if rows >= HELD:
                    held = best()
                    rows = sum(x.num_rows for x in held)
                    if rows >= HELD // 2:
                        yield from held
                        held, rows = [], 0
        if rows:
            yield from best()

    found = met.mapInArrow(run, schema)
    return ranked(found, [F.desc("estimate"), F.col("doc_id")], shortlist, "place").select("query_id", "doc_id")


def search(index: Versions, queries: DataFrame, vectors: DataFrame, k: int, probes: int | None = None, shortlist: int = SHORTLIST, decimals: int | None = None) -> DataFrame:
    """query_id, doc_id, score and rank: the ``k`` best of the shortlist by the exact cosine.

    ``vectors`` are those that were indexed; of the rows that share a doc_id all are
    scored.
    """
    short = materialize(candidates(index, queries, probes, max(k, shortlist)).distinct(), "shortlist")
    q = queries.select("query_id", F.col("vector").alias("qv")).withColumn("qn", norm(F.col("qv")))
    v = vectors.select("doc_id", "vector").join(small(short), "doc_id").withColumn("vn", norm(F.col("vector")))
    sim = F.try_divide(dot(F.col("qv"), F.col("vector")), F.col("qn") * F.col("vn"))
    scored = v.join(q, "query_id").select("query_id", "doc_id", (sim if decimals is None else F.round(sim, decimals)).alias("score"))
    return ranked(scored.where("score is not null"), [F.desc("score"), F.col("doc_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n (exact rows) and recall: the share of them that ``found`` has, both with query_id and doc_id."""
    hit = found.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct()
    return exact.join(hit, ["query_id", "doc_id"], "left").agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))
