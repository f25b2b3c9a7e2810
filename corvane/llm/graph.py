"""Connected components of a large graph by alternating stars.

Each round first links every node's larger neighbours to its smallest one and
then its smaller neighbours, until nothing changes; the number of rounds grows
with the logarithm of the longest path. A node's smallest neighbour is an
aggregate with map-side combine, so a hub's neighbours never meet in one task,
and every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One step over edges (u > v): to the smallest neighbour of u."""
    if both:  # large star: all neighbours, links of the larger ones
        sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # small star: smaller neighbours only
        sides = edges
    low = sides.groupBy("u").agg(F.min("v").alias("m"))
    met = sides.join(low, "u")
    if both:
        out = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        out = out.unionAll(low.where("m < u").select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(low.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) of all nodes of ``edges``.

    ``edges`` has columns u and v in any order; loops and repeats are ignored.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = materialize(_star(_star(now, True), False), "edges")
        release(now)
        now = new
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
