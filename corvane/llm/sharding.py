"""Sharding by longest processing time: groups that stay together, sizes near equal.

A group is all rows with equal texts. Groups sorted by their bytes, largest first
(equal ones by digest), go one after the other to the shard with the least load,
ties to the lower number. Shards wait in a heap.

The groups of one size need no step each: with ``load = level * size + rest`` the
shards of the least level take turns in the order of (rest, shard), and a waiting
shard leaves the heap when the level reaches its own. So a run of equal sizes is
described by as many turns as shards join, and a group finds its shard by its
place in the run. The result is that of the plain heap over single groups.

Only runs pass through one task, streamed in order: the different sizes of groups
(at most ``sqrt(2 * total bytes)``, as their sum is bounded by the total) and one
more for each partition border. Groups are 32-byte digests with sums,
pre-aggregated; texts are read once and never shuffled. Rows find their group by a
join of written tables, which AQE splits at a text that holds many rows.

Defined results: a null text is the empty text, of size 1; null doc_ids come first
in a shard; equal rows stay equal rows with slots of their own. A group larger
than a shard's share stays whole, as it must, so its shard is larger than others.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from .arrowio import map_rows

SHARDS = 8
TURNS = "array<struct<start:long,shards:array<int>>>"


class Loads:
    """Loads of the shards; :meth:`put` places a run of groups of one size."""

    def __init__(self, shards: int) -> None:
        self.bytes = [0] * shards

    def put(self, size: int, count: int) -> list[tuple[int, list[int]]]:
        """Turns (first place, shards in order): places from there on go round these shards."""
        waiting = [(load // size, load % size, shard) for shard, load in enumerate(self.bytes)]
        heapq.heapify(waiting)
        turns, taking, done = [], [], 0
        while done < count:
            level = waiting[0][0] if waiting else 0
            while waiting and waiting[0][0] == level:
                taking.append(heapq.heappop(waiting)[1:])
            taking.sort()
            left = count - done
            take = min(left, (waiting[0][0] - level) * len(taking)) if waiting else left
            turns.append((done, [shard for _, shard in taking]))
            for i, (_, shard) in enumerate(taking):
                self.bytes[shard] += size * (take // len(taking) + (i < take % len(taking)))
            done += take
        return turns


def schedule(runs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """part, bytes and turns of runs of equal groups (part, bytes, first, n), taken in the order of first."""

    def make():
        loads = Loads(shards)
        return lambda row: [(row[0], row[1], [{"start": a, "shards": s} for a, s in loads.put(row[1], row[3])])]

    ordered = runs.select("part", "bytes", "first", "n").coalesce(1).sortWithinPartitions("first")
    return map_rows(ordered, make, f"part long, bytes long, turns {TURNS}")


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` sorted over all partitions, as a scratch table with ``part`` and a ``place`` that grows within it."""
    place = F.monotonically_increasing_id()
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place)
    return materialize(out.withColumn("part", F.shiftright("place", 33)), "shard-order")


def group_shards(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """digest and shard of groups (digest, bytes)."""
    ordered = numbered(groups.select("digest", "bytes"), F.desc("bytes"), F.col("digest"))
    runs = ordered.groupBy("part", "bytes").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    firsts = runs.select("part", "bytes", "first").join(materialize(schedule(runs, shards), "shard-turns"), ["part", "bytes"])
    turn = F.element_at(F.filter("turns", lambda t: t["start"] <= F.col("at")), -1)
    found = ordered.join(firsts, ["part", "bytes"]).select("digest", (F.col("place") - F.col("first")).alias("at"), "turns").select("digest", "at", turn.alias("turn"))
    return found.select("digest", F.get("turn.shards", F.pmod(F.col("at") - F.col("turn.start"), F.size("turn.shards")).cast("int")).alias("shard"))


def assign(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    ``size`` is the UTF-8 bytes of the text plus 1; slots number the rows of a
    shard from 0 by doc_id without gaps.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = rows.join(materialize(group_shards(groups, shards), "shard-groups"), "digest").drop("digest")
    placed = numbered(placed, F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("row"))
    release(rows)
    # a partition holds one shard or borders: at most partitions + shards rows
    parts = placed.groupBy("part", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(parts), ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot and grown_shard (null: the law isn't by key)."""
    return assign(documents).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sql(shards: int = SHARDS) -> str:
    """The plain heap, one group a step of a recursion, and the CRC bit by bit from its polynomial."""
    zeros = ", ".join(["CAST(0 AS BIGINT)"] * shards)
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    steps = ", ".join(f"s{i} AS (SELECT i, {bit.format('c')} AS c FROM {'bytes' if i == 0 else f's{i - 1}'})" for i in range(8))
    return f"""
WITH RECURSIVE bytes AS (SELECT i, i AS c FROM range(0, 256) AS r(i)), {steps}, crc AS (
  SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM s7
), d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS data, sha256(coalesce(text, '')) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents
), g AS MATERIALIZED (
  SELECT h, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, h) AS i FROM d GROUP BY h
), lpt AS (
  SELECT CAST(0 AS BIGINT) AS i, [{zeros}] AS loads, '' AS h, 0 AS shard
  UNION ALL
  SELECT g.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + g.bytes ELSE x END), g.h, list_position(loads, list_min(loads)) - 1 FROM lpt JOIN g ON g.i = lpt.i + 1
), sums AS (
  SELECT doc_id, h, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(data), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)])), 4294967295) AS c FROM d, crc
)
SELECT doc_id, size, c AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sums JOIN lpt USING (h)
"""
