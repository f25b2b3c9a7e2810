"""Frontiers of many starts as packed rows: a row for a block of starts and a block of nodes.

Nodes and starts are whole numbers. A block has ``STARTS`` starts and ``2 ** bits`` nodes that follow each
other; its entries are codes (the node's place in its block times ``STARTS``, plus the start's number in its
own) and numbers of paths, in as few bytes as these need. A step deals the frontier by blocks of nodes to
the edges that leave them, which are multiplied and summed there; the sums are dealt by both blocks, so that a task meets a block's
visited nodes beside them. Neither step has a row an entry: a row has ``ENTRIES`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..session import import_path, materialize

#: Starts of a block, entries of a row, edges of a block that are held at once, and cells of a matrix of targets and starts.
STARTS, ENTRIES, HELD, CELLS = 32, 1 << 15, 1 << 21, 1 << 20
#: Bits of a node's place in its block, at least and at most; blocks that are aimed at.
BITS, BLOCKS = (12, 16), 64
#: Edges rather than entries are gone through where so large a share of the block's matrix is filled.
FULL = 0.25

PACKED = StructType([StructField("block", LongType()), StructField("place", LongType()), *(StructField(c, BinaryType()) for c in ("ids", "codes", "paths"))])
LINKS = StructType([StructField("place", LongType()), StructField("piece", LongType()), *(StructField(c, BinaryType()) for c in ("nodes", "targets"))])


def width(low: int, high: int) -> int:
    """Bits of a node's place in its block, for nodes from ``low`` to ``high``."""
    return min(max(((high - low) // BLOCKS).bit_length(), BITS[0]), BITS[1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(column[at].as_py() for column in batch.columns)


def _batches(rows: Iterator[tuple], schema: StructType, most: int = 64) -> Iterator[pa.RecordBatch]:
    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow, strict=True)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow, strict=True)], schema=arrow)


def _written(block: int, ids: bytes, place: int, codes: np.ndarray, paths: np.ndarray) -> Iterator[tuple]:
    """Packed rows of entries of one block of starts and one of nodes."""
    for at in range(0, len(codes), ENTRIES):
        some = paths[at : at + ENTRIES]
        small = np.min_scalar_type(int(some.max()))
        yield block, place, ids, codes[at : at + ENTRIES].astype(np.uint32).tobytes(), some.astype(small).tobytes()


def _read(codes: bytes, paths: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(codes, np.uint32)
    return own, np.frombuffer(paths, f"u{len(paths) // len(own)}")


def starting(starts: DataFrame, bits: int) -> DataFrame:
    """The packed frontier of ``starts`` (start: different, no nulls): each reaches itself along one path."""
    import_path(starts.sparkSession)
    parts = max(1, starts.count() // (8 * STARTS))
    ordered = starts.select(F.col("start").cast("long")).repartitionByRange(parts, "start").sortWithinPartitions("start")

    def run(batches):
        def rows():
            n = 0
            for batch in batches:
                for at in range(0, batch.num_rows, STARTS):
                    part = batch.slice(at, STARTS)
                    own, block = part.column(0).to_numpy(), (part.column(1)[0].as_py() << 32) + n
                    n += 1
                    places, codes = own >> bits, (own & ((1 << bits) - 1)) * STARTS + np.arange(len(own))
                    for place in np.unique(places):
                        here = codes[places == place]
                        yield from _written(block, own.astype(np.int64).tobytes(), int(place), here, np.ones(len(here), np.int64))

        yield from _batches(rows(), PACKED)

    return materialize(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, PACKED), "frontier")


def links(edges: DataFrame, bits: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges (node, target: different, no nulls) packed by blocks of nodes, and place and pieces of those blocks that are dealt to several tasks.

    A block of more than ``HELD`` edges is cut into pieces by target.
    """
    import_path(edges.sparkSession)
    place = F.shiftright(F.col("node").cast("long"), bits)
    rows = edges.select(place.alias("place"), F.col("node").cast("long").alias("node"), F.col("target").cast("long").alias("target"))
    heavy = materialize(rows.groupBy("place").count().where(F.col("count") > HELD).select("place", F.ceil(F.col("count") / HELD).alias("pieces")), "heavy")
    if heavy.limit(1).count():
        piece = F.pmod(F.xxhash64("target"), F.coalesce("pieces", F.lit(1)))
        rows = rows.join(F.broadcast(heavy), "place", "left")  # a row for HELD edges at most
    else:
        heavy, piece = None, F.lit(0)
    rows = rows.select("place", piece.cast("long").alias("piece"), "node", "target")

    def run(batches):
        def packed():
            for batch in batches:
                place, piece, node, target = (c.to_numpy() for c in batch.columns)
                ends = np.flatnonzero((place[1:] != place[:-1]) | (piece[1:] != piece[:-1])) + 1
                for a, b in zip([0, *ends], [*ends, len(place)], strict=True):
                    if a < b:
                        yield int(place[a]), int(piece[a]), (node[a:b] & ((1 << bits) - 1)).astype(np.uint32).tobytes(), target[a:b].tobytes()

        yield from _batches(packed(), LINKS)

    dealt = rows.repartition("place", "piece").sortWithinPartitions("place", "piece", "target")
    return materialize(dealt.mapInArrow(run, LINKS), "links"), heavy


class Block:
    """The edges that leave a block of nodes, for products with frontiers of a block of starts."""

    def __init__(self, nodes: np.ndarray, targets: np.ndarray, bits: int, whole: type = np.int64) -> None:
        self.bits, self.whole = bits, whole
        order = np.argsort(targets, kind="stable")
        self.node, target = nodes[order].astype(np.intp), targets[order]
        first = np.r_[True, target[1:] != target[:-1]]
        self.runs, number = np.flatnonzero(first), np.cumsum(first) - 1
        self.target = target[self.runs]
        self.degree = np.bincount(self.node, minlength=1 << bits)
        self.first, self.to = np.cumsum(self.degree) - self.degree, number[np.argsort(self.node, kind="stable")]
        self.sources, self.layers = np.count_nonzero(self.degree), None

    def _layers(self) -> list[tuple]:
        """For some targets at a time: those with most edges first, and the nodes of their first edges, of their second ones, ..."""
        if self.layers is None:
            self.layers, ends, step = [], np.r_[self.runs, len(self.node)], CELLS // STARTS
            for at in range(0, len(self.target), step):
                runs, n = ends[at : at + step + 1][:-1], np.diff(ends[at : at + step + 1])
                order = np.argsort(-n, kind="stable")
                runs, n = runs[order], n[order]
                met = np.searchsorted(-n, -np.arange(n[0]), "left")  # targets with more than so many edges
                self.layers.append((at, order, [self.node[runs[:m] + k] for k, m in enumerate(met)]))
        return self.layers

    def products(self, codes: np.ndarray, paths: np.ndarray, starts: int) -> Iterator[tuple]:
        """(target, start's number, paths), ordered by target, in parts that share no target."""
        cost = self.degree[codes // STARTS]
        many, cells = cost.sum(), len(self.target) * STARTS
        if not many:
            return
        if len(codes) >= FULL * self.sources * starts or (many >= cells // 16 and cells > 8 * CELLS):
            matrix = np.zeros((1 << self.bits, STARTS), self.whole)
            matrix.reshape(-1)[codes] = paths
            for at, order, layers in self._layers():
                total = np.zeros((len(order), STARTS), self.whole)
                for nodes in layers:
                    total[: len(nodes)] += matrix[nodes]
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                total = total[back]
                row, start = np.nonzero(total)
                yield self.target[at + row], start, total[row, start]
            return
        inner = np.arange(many) - np.repeat(np.cumsum(cost) - cost, cost)
        key = self.to[np.repeat(self.first[codes // STARTS], cost) + inner] * STARTS + np.repeat(codes % STARTS, cost)
        each = np.repeat(paths.astype(np.int64), cost)
        key, total = _summed(key, each, cells)
        yield self.target[key // STARTS], key % STARTS, total


def _summed(key: np.ndarray, paths: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys under ``cells``, in order, and the sums of their paths."""
    if len(key) >= cells // 16:
        total = np.zeros(cells, np.int64)
        np.add.at(total, key, paths)
        key = np.flatnonzero(total)
        return key, total[key]
    order = np.argsort(key, kind="stable")
    key = key[order]
    runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[runs], np.add.reduceat(paths[order], runs)


def _products(frontier: DataFrame, edges: DataFrame, heavy: DataFrame | None, bits: int, whole: type) -> DataFrame:
    """Packed sums, by target, of a frontier's paths along the edges of each block of nodes."""
    none = F.lit(None)
    mine = frontier.withColumn("piece", F.lit(0).cast("long"))
    if heavy is not None:
        mine = frontier.join(F.broadcast(heavy), "place", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)))
    rows = edges.select("place", "piece", none.cast("long").alias("block"), none.cast("binary").alias("ids"), F.col("nodes").alias("codes"), F.col("targets").alias("paths"))
    rows = rows.unionAll(mine.select("place", "piece", "block", "ids", "codes", "paths"))
    rows = rows.repartition("place", "piece").sortWithinPartitions("place", "piece", F.asc_nulls_first("block"))

    def run(batches):
        def sums(edges: Block | None, block: int | None, ids: bytes, held: list):
            if edges is None or block is None:
                return
            codes, paths = (np.concatenate(x) for x in zip(*(_read(*h) for h in held), strict=True))
            for target, start, total in edges.products(codes.astype(np.intp), paths, len(ids) // 8):
                place, code = target >> bits, (target & ((1 << bits) - 1)) * STARTS + start
                ends = np.flatnonzero(place[1:] != place[:-1]) + 1
                for a, b in zip([0, *ends], [*ends, len(place)], strict=True):
                    if a < b:
                        yield from _written(block, ids, int(place[a]), code[a:b], total[a:b])

        def rows():
            key, edges, links, block, ids, held = None, None, [], None, b"", []
            for *new, mine, own, codes, paths in _rows(batches):
                if new != key or mine != block:
                    yield from sums(edges, block, ids, held)
                    block, ids, held = mine, own, []
                if new != key:
                    key, edges, links = new, None, []
                if mine is None:
                    links.append((codes, paths))
                    continue
                if links:
                    edges, links = Block(np.concatenate([np.frombuffer(x, np.uint32) for x, _ in links]), np.concatenate([np.frombuffer(x, np.int64) for _, x in links]), bits, whole), []
                held.append((codes, paths))
            yield from sums(edges, block, ids, held)

        yield from _batches(rows(), PACKED)

    return rows.mapInArrow(run, PACKED)


def step(frontier: DataFrame, visited: list[DataFrame], edges: DataFrame, heavy: DataFrame | None, bits: int, most: int) -> DataFrame:
    """The next packed frontier: what ``frontier`` reaches along an edge and none of ``visited`` has, with sums of paths, ``most`` at most."""
    rows = _products(frontier, edges, heavy, bits, np.int32 if most < 1 << 31 else np.int64)
    for known in visited:
        rows = rows.unionAll(known.withColumn("paths", F.lit(None).cast("binary")))
    rows = rows.repartition("block", "place").sortWithinPartitions("block", "place")
    cells = STARTS << bits

    def run(batches):
        def fold(total: np.ndarray | None, held: list) -> np.ndarray:
            total = np.zeros(cells, np.int64) if total is None else total
            for codes, paths in held:
                own, n = _read(codes, paths)
                total[own] += n  # a row has an entry once
            return total

        def fresh(total, held, seen):
            known = np.concatenate([np.frombuffer(x, np.uint32) for x in seen]) if seen else np.zeros(0, np.uint32)
            if total is None and sum(len(h[0]) for h in held) // 4 < cells // 16:
                if not held:
                    return known[:0], known[:0]
                codes, paths = (np.concatenate(x) for x in zip(*(_read(*h) for h in held), strict=True))
                codes, paths = _summed(codes.astype(np.intp), paths.astype(np.int64), 1 << 62)
                new = ~np.isin(codes, known)
                return codes[new], paths[new]
            total = fold(total, held)
            total[known] = 0
            codes = np.flatnonzero(total)
            return codes, total[codes]

        def rows():
            key, ids, total, held, size, seen = None, b"", None, [], 0, []
            for block, place, own, codes, paths in _rows(batches):
                if (block, place) != key:
                    if key:
                        yield from _written(key[0], ids, key[1], *fresh(total, held, seen))
                    key, ids, total, held, size, seen = (block, place), own, None, [], 0, []
                if paths is None:
                    seen.append(codes)
                    continue
                held.append((codes, paths))
                size += len(codes) // 4
                if size >= cells // 8:
                    total, held, size = fold(total, held), [], 0
            if key:
                yield from _written(key[0], ids, key[1], *fresh(total, held, seen))

        yield from _batches(rows(), PACKED)

    return materialize(rows.mapInArrow(run, PACKED), "frontier")


def unpacked(frontier: DataFrame, bits: int) -> DataFrame:
    """start, node and paths of a packed frontier, a row an entry."""
    import_path(frontier.sparkSession)
    schema = StructType([StructField(c, LongType()) for c in ("start", "node", "paths")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for _, place, ids, codes, paths in _rows(batches):
            codes, paths = _read(codes, paths)
            start, node = np.frombuffer(ids, np.int64)[codes % STARTS], (place << bits) + (codes // STARTS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(node), pa.array(paths.astype(np.int64))], schema=arrow)

    return frontier.mapInArrow(run, schema)
