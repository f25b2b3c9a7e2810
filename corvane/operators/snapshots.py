"""Differences of two snapshots by trees of hashes.

A tree has buckets of rows, dealt by a hash of the key, at its leaves: as many as
give ``LEAF`` rows a bucket, a power of ``FAN``. A node's digest is the count and
two sums of its rows' hashes, so it doesn't depend on their order and a level is
one aggregation of the one below. The rows are stored by bucket, the nodes by
level.

Two trees are compared from the root: only children of nodes that differ are read,
and at the leaves only the rows of buckets that differ. For k changed rows of n that is
at most ``FAN * k`` nodes a level, of ``log(n / LEAF)`` levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.versions import Versions

FAN_BITS, LEAF = 4, 1000
ROWS, NODES = "rows", "nodes"


def depth_for(rows: int, leaf: int = LEAF) -> int:
    """Levels below the root for ``rows`` rows."""
    depth = 0
    while leaf << (FAN_BITS * depth) < rows:
        depth += 1
    return depth


def _bucket(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(77)), 64 - FAN_BITS * depth) if depth else F.lit(0).cast("long")


def build(df: DataFrame, key: str, root: str, depth: int | None = None, leaf: int = LEAF) -> Versions:
    """Write the tree of ``df`` as one version of ``root``; its depth follows the row count unless given."""
    index = Versions(df.sparkSession, root)
    names = sorted(c for c in df.columns if c != key)
    depth = depth_for(df.count(), leaf) if depth is None else depth
    line = F.to_json(F.struct(key, *names), {"ignoreNullFields": "false"})
    rows = df.select(_bucket(key, depth).alias("bucket"), F.col(key).cast("string").alias("key"), F.sha2(line, 256).alias("digest"))
    state = index.stage(rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket"), ROWS)
    stored = index.spark.read.parquet(f"{index.root}/data/{state['folders'][0]}")
    sums = [F.sum(F.xxhash64("digest", "key", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    level = materialize(stored.groupBy(F.col("bucket").alias("node")).agg(F.count("*").alias("n"), *sums), "tree-level")
    nodes = level.select(F.lit(depth).alias("level"), "*")
    for d in range(depth - 1, -1, -1):
        level = materialize(level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"), F.sum("s0").cast("decimal(38,0)").alias("s0"), F.sum("s1").cast("decimal(38,0)").alias("s1")), "tree-level")
        nodes = nodes.unionAll(level.select(F.lit(d).alias("level"), "*"))
    index.commit({ROWS: state, NODES: index.stage(nodes.repartitionByRange("level", "node").sortWithinPartitions("level", "node"), NODES, "level")}, index.state()["version"], {"depth": depth, "key": key})
    return index


def differing(one: Versions, other: Versions) -> tuple[DataFrame, int]:
    """(buckets that differ, nodes read on the way); both trees have one depth."""
    depth = one.state()["facts"]["depth"]
    if other.state()["facts"]["depth"] != depth:
        raise ValueError("the trees differ in depth; build one with the depth of the other")
    a, b = one.read(NODES), other.read(NODES)
    frontier, read = None, 0
    for level in range(depth + 1):
        sides = []
        for tree in (a, b):
            nodes = tree.where(F.col("level") == level).drop("level")
            if frontier is not None:
                nodes = nodes.join(frontier, F.shiftright(nodes["node"], FAN_BITS) == frontier["parent"], "left_semi")
            sides.append(nodes)
        met = sides[0].join(sides[1].toDF("node", "n2", "t0", "t1"), "node", "full_outer")
        same = F.col("n").eqNullSafe(F.col("n2")) & F.col("s0").eqNullSafe(F.col("t0")) & F.col("s1").eqNullSafe(F.col("t1"))
        seen = materialize(met.select(F.col("node").alias("parent"), same.alias("same"), (F.col("n").isNotNull().cast("int") + F.col("n2").isNotNull().cast("int")).alias("read")), "tree-frontier")
        read += seen.agg(F.coalesce(F.sum("read"), F.lit(0))).first()[0]
        frontier = seen.where("not same").select("parent")
    return frontier.withColumnRenamed("parent", "bucket"), read


def difference(one: Versions, other: Versions) -> DataFrame:
    """key and change (added, removed, changed) from ``one`` to ``other``.

    Keys are shown as strings. Rows that share a key are compared as a multiset:
    a key whose rows aren't all the same is changed where both have it. A null key
    is a key.
    """
    buckets = differing(one, other)[0]
    sums = lambda df, n: df.join(F.broadcast(buckets) if buckets.limit(50_001).count() <= 50_000 else buckets, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias(f"n{n}"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias(f"s{n}"), F.max("digest").alias(f"d{n}"))
    a, b = sums(one.read(ROWS), 1), sums(other.read(ROWS), 2)
    met = a.join(b.withColumnRenamed("key", "key2"), F.col("key").eqNullSafe(F.col("key2")), "full_outer")
    same = (F.col("n1") == F.col("n2")) & (F.col("s1") == F.col("s2")) & (F.col("d1") == F.col("d2"))
    change = F.when(F.col("n1").isNull(), "added").when(F.col("n2").isNull(), "removed").when(~same, "changed")
    return met.select(F.coalesce("key", "key2").alias("key"), change.alias("change")).where("change is not null")
