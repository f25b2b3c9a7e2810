"""Chains of citations: who is reached in how many steps, and along how many shortest paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from ..session import import_path, materialize, release, tidy
from . import frontiers

#: No number of paths under it overflows eight bytes.
LONG = 1 << 63
#: Whole keys are packed by blocks (``frontiers``) where their range is at most so many times the number of edges.
RANGE = 64
#: Keys that go to one task, rows that it holds, and products that it makes at once.
KEYS, HELD, PRODUCTS = 1 << 14, 1 << 21, 1 << 22


def _sums(edges: tuple, entries: tuple, dense: float = 1 / 32):
    """(start, target, paths): products of edges (node, target) and entries (node, start, paths), summed piece by piece.

    A matrix, nodes by starts, is made where at least the share ``dense`` of it is filled.
    """
    nodes, at = np.unique(entries[0], return_inverse=True)
    place = np.searchsorted(nodes, edges[0])
    met = np.flatnonzero(nodes[np.minimum(place, len(nodes) - 1)] == edges[0])
    met = met[np.argsort(edges[1][met], kind="stable")]
    place, target = place[met], edges[1][met]
    starts, column = np.unique(entries[1], return_inverse=True)
    full = len(at) >= dense * len(nodes) * len(starts)
    if full:
        matrix = np.zeros((len(nodes), len(starts)), np.int64)
        matrix[at, column] = entries[2]
        cost = np.full(len(met), len(starts))
    else:
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=len(nodes))
        first, cost = np.cumsum(n) - n, n[place]
    cuts = np.searchsorted(np.cumsum(cost), np.arange(PRODUCTS, cost.sum() + 1, PRODUCTS))
    for a, b in zip([0, *(cuts + 1)], [*(cuts + 1), len(met)], strict=True):
        if a == b:
            continue
        if full:
            runs = np.flatnonzero(np.r_[True, target[a + 1 : b] != target[a : b - 1]])
            total = np.add.reduceat(matrix[place[a:b]], runs)
            row, col = np.nonzero(total)
            yield starts[col], target[a:b][runs][row], total[row, col]
        else:
            each = cost[a:b]
            inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            entry = order[np.repeat(first[place[a:b]], each) + inner]
            to, start, paths = np.repeat(target[a:b], each), entries[1][entry], entries[2][entry]
            by = np.lexsort((start, to))
            to, start = to[by], start[by]
            runs = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (start[1:] != start[:-1])])
            yield start[runs], to[runs], np.add.reduceat(paths[by], runs)


def _products(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """start, target and paths, in parts: nodes that are near each other go to one task, edges before the frontier's rows.

    A task holds ``HELD`` rows and the edges of a node.
    """
    import_path(edges.sparkSession)
    schema = StructType([StructField(c, LongType()) for c in ("start", "target", "paths")])
    arrow = to_arrow_schema(schema)
    rows = edges.selectExpr("cast(node AS bigint) AS node", "cast(target AS bigint) AS other", "cast(NULL AS bigint) AS paths")
    rows = rows.unionAll(frontier.selectExpr("cast(node AS bigint)", "cast(start AS bigint)", "cast(paths AS bigint)"))
    rows = rows.repartition(F.floor(F.col("node") / KEYS)).sortWithinPartitions("node", "paths")

    def run(batches):
        held, size, kept = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def work():
            nonlocal kept
            node, other, paths = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in range(3))
            edge = paths.is_null().to_numpy(zero_copy_only=False)
            node, other, paths = node.to_numpy(), other.to_numpy(), paths.fill_null(0).to_numpy()
            mine = np.r_[kept[0], node[edge]], np.r_[kept[1], other[edge]]
            last = mine[0] == node[-1]
            kept = mine[0][last], mine[1][last]
            if len(mine[0]) and not edge.all():
                for part in _sums(mine, (node[~edge], other[~edge], paths[~edge])):
                    for at in range(0, len(part[0]), 1 << 18):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]) for x in part], schema=arrow)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield from work()
                held, size = [], 0
        if size:
            yield from work()

    return rows.mapInArrow(run, schema)


def _packed_steps(edges: DataFrame, starts: DataFrame, depth: int, most: int, bits: int) -> tuple[list[DataFrame], int]:
    """start, node and paths of every step that has rows and whose paths are under ``LONG``, and the step to go on with."""
    links, heavy = frontiers.links(edges, bits)
    packed, hop = [frontiers.starting(starts, bits)], 1
    while hop <= depth and most**hop < LONG:
        fresh = frontiers.step(packed[-1], packed, links, heavy, bits, most**hop)
        tidy(edges.sparkSession)  # a step's shuffle files are not read again
        hop += 1
        if not fresh.limit(1).count():
            hop = depth + 1
            break
        packed.append(fresh)
    release(links)
    return [frontiers.unpacked(p, bits) for p in packed], hop


def citation_chains(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, hops and paths of the nodes within ``depth`` steps of each start.

    Breadth first over edges (source, target): a step joins the frontier with the
    edges, sums paths by (start, node), and what has been visited is dropped. So a
    cycle ends by itself and a node is expanded once a start. Where keys are whole
    numbers without large gaps, frontiers are packed (``frontiers``): neither sums nor visited
    nodes are shuffled a row each. With gaps, the edges that leave the frontier are
    multiplied and summed in the tasks, and an anti-join drops what has been visited; other keys have
    a row an edge. ``hops`` is
    the distance and ``paths`` the number of different shortest chains, as a
    decimal; while the largest number of edges into a node, to the power of the step, is
    under ``LONG`` they are summed as whole numbers of eight bytes. Every frontier is a scratch table, so a lost executor costs a step at
    most.

    Defined results: repeated edges count once; edges with a null end, loops and null
    starts lead nowhere; a start itself is not returned.
    """
    e = edges.select(F.col("source").alias("node"), "target").where("node <> target").distinct()
    e = materialize(e, "edges")
    most = e.groupBy("target").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    from_here = starts.toDF("start").where("start is not null").distinct()
    kinds = from_here.schema["start"].dataType, e.schema["target"].dataType
    whole = all(isinstance(t, IntegralType) for t in (e.schema["node"].dataType, *kinds))
    steps, first = [], 1
    if whole:
        low, high, n = e.agg(F.least(F.min("node"), F.min("target")), F.greatest(F.max("node"), F.max("target")), F.count("*")).first()
        if n and high - low < RANGE * n:
            steps, first = _packed_steps(e, from_here, depth, most, frontiers.width(low, high))
            steps = [step.select(F.col("start").cast(kinds[0]), F.col("node").cast(kinds[1] if hop else kinds[0]), F.lit(hop).alias("hops"), "paths") for hop, step in enumerate(steps)]
    if not steps:
        steps = [materialize(from_here.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(1).cast("long").alias("paths")), "frontier")]
    frontier = steps[-1]
    for hop in range(first, depth + 1):
        kind = "long" if most**hop < LONG else "decimal(38,0)"
        if whole and kind == "long":
            parts = _products(frontier, e).select(F.col("start").cast(kinds[0]), F.col("target").cast(kinds[1]), "paths")
        else:
            parts = frontier.join(e, "node").select("start", "target", F.col("paths").cast(kind))
        reached = parts.groupBy("start", "target").agg(F.sum("paths").cast(kind).alias("paths"))
        visited = steps[0].select("start", "node")
        for step in steps[1:]:
            visited = visited.unionAll(step.select("start", "node"))
        fresh = reached.withColumnRenamed("target", "node").join(visited, ["start", "node"], "left_anti")
        frontier = materialize(fresh.select("start", "node", F.lit(hop).alias("hops"), "paths"), "frontier")
        if not frontier.limit(1).count():
            break
        steps.append(frontier)
    release(e)
    steps = [step.withColumn("paths", F.col("paths").cast("decimal(38,0)")) for step in steps]
    out = steps[0].where("hops > 0")
    for step in steps[1:]:
        out = out.unionAll(step)
    return out


def lineage(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """start, node, hops and via: the smallest node in front of each on a shortest chain (for hops of 1 the start)."""
    e = edges.select(F.col("source").alias("via"), F.col("target").alias("node")).where("via <> node").distinct()
    own = chains.select("start", F.col("start").alias("via"), F.lit(0).alias("before")).distinct()
    before = chains.select("start", F.col("node").alias("via"), F.col("hops").alias("before")).unionAll(own)
    met = chains.select("start", "node", "hops").join(e, "node").join(before, ["start", "via"]).where("before = hops - 1")
    return met.groupBy("start", "node", "hops").agg(F.min("via").alias("via"))
