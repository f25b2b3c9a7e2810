"""Resampling statistics over tables of per-query values.

The values are mostly a few hundred rows; the replicates are what is large, so
these are dealt over the cluster. Up to ``BROADCAST_VALUES`` values go to the tasks
as arrays; more are joined draw by draw, with the same indices. Indices come either from a hash of (seed, replicate,
draw), which any engine can repeat, or from a NumPy generator whose stream is
fixed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import import_path, materialize

REPLICATES, SEED = 10_000, 20260531
BROADCAST_VALUES = 1_000_000


def _values(values: DataFrame, group: list[str]) -> DataFrame:
    """One row a group: its values in the order of ``id``."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda r: r["value"].cast("double"))
    return values.groupBy(*group).agg(rows.alias("v"))


def _drawn(rep: Column, draw: Column, n: Column, seed: int) -> Column:
    """The index of a draw: MD5 of seed|rep|draw modulo ``n``."""
    key = F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), draw.cast("string"))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def hash_means(values: DataFrame, group: list[str], b: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """group, rep and mean of each replicate; indices by MD5 of seed|rep|draw."""
    if values.limit(BROADCAST_VALUES + 1).count() > BROADCAST_VALUES:
        return _joined_means(values, group, b, seed)
    reps = values.sparkSession.range(b).select(F.col("id").cast("int").alias("rep"))  # dealt over all cores, as few groups aren't
    v = reps.join(F.broadcast(_values(values, group)))
    at = lambda i: _drawn(F.col("rep"), i, F.size("v"), seed)
    total = F.aggregate(F.sequence(F.lit(0), F.size("v") - 1), F.lit(0.0), lambda acc, i: acc + F.get("v", at(i)))
    return v.select(*group, "rep", F.size("v").alias("n"), (F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x) / F.size("v")).alias("mean"), (total / F.size("v")).alias("m"))


def _joined_means(values: DataFrame, group: list[str], b: int, seed: int) -> DataFrame:
    """:func:`hash_means` with a row a draw: each is joined with the value of its index."""
    w = Window.partitionBy(*group).orderBy("id", "value")
    placed = materialize(values.select(*group, F.col("value").cast("double").alias("value"), (F.row_number().over(w) - 1).alias("at")), "values")
    sizes = placed.groupBy(*group).agg(F.count("*").cast("int").alias("n"), F.avg("value").alias("mean"))
    reps = values.sparkSession.range(b).select(F.col("id").cast("int").alias("rep"))
    draws = sizes.join(reps).select(*group, "n", "mean", "rep", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("draw"))
    drawn = draws.withColumn("at", _drawn(F.col("rep"), F.col("draw"), F.col("n"), seed))
    return drawn.join(placed, [*group, "at"]).groupBy(*group, "rep", "n", "mean").agg(F.avg("value").alias("m")).select(*group, "rep", "n", "mean", "m")


def interval(means: DataFrame, group: list[str]) -> DataFrame:
    """group, n, mean, lo and hi: linear percentiles 2.5 and 97.5 of the replicates."""
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    out = means.groupBy(*group).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), q.alias("q"))
    return out.select(*group, "n", "mean", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))


def bootstrap(values: DataFrame, group: list[str], b: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Confidence interval of the mean of ``value`` in each group (id orders the values)."""
    return interval(hash_means(values, group, b, seed), group)


def paired(a: DataFrame, other: DataFrame, group: list[str], b: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Interval of the differences of two value tables with the same ids."""
    diff = a.join(other.withColumnRenamed("value", "other"), [*group, "id"]).select(*group, "id", (F.col("value") - F.col("other")).alias("value"))
    return bootstrap(diff, group, b, seed).withColumn("includes_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0))


def leave_one_out(diffs: DataFrame, b: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The interval without each id in turn: left_out, n, mean, lo, hi, excludes_zero.

    The draws of a replicate are the same whichever id is left out, so a replicate
    draws once: place k is value k for the ids behind it and value k + 1 for the
    others. Differences between one id and the next add up to all means.
    """
    if diffs.limit(BROADCAST_VALUES + 1).count() > BROADCAST_VALUES:
        raise ValueError(f"leave-one-out of more than {BROADCAST_VALUES} values: {REPLICATES} replicates of as many intervals")
    v = diffs.agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("v")).withColumn("size", F.size("v"))
    reps = diffs.sparkSession.range(b).select(F.col("id").cast("int").alias("rep")).join(F.broadcast(v)).where("size > 1")
    draws = reps.select("rep", "v", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 2)).alias("draw"))
    k = _drawn(F.col("rep"), F.col("draw"), F.col("size") - 1, seed)
    value = lambda at: F.get("v", at)["value"].cast("double")
    steps = draws.select("rep", "size", "v", k.alias("k")).select("rep", "size", "k", value(F.col("k")).alias("own"), value(F.col("k") + 1).alias("next"))
    starts = steps.groupBy("rep", "size").agg(F.sum("next").alias("total")).select("rep", "size", F.lit(0).alias("at"), F.col("total").alias("d"))
    changes = steps.select("rep", "size", (F.col("k") + 1).alias("at"), (F.col("own") - F.col("next")).alias("d")).unionAll(starts)
    grid = reps.select("rep", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"), F.lit(0.0).alias("d"))
    each = changes.unionAll(grid).groupBy("rep", "size", "at").agg(F.sum("d").alias("d"))
    so_far = Window.partitionBy("rep").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    means = each.select("rep", "at", (F.col("size") - 1).alias("n"), (F.sum("d").over(so_far) / (F.col("size") - 1)).alias("m"))
    ends = means.groupBy("at").agg(F.first("n").alias("n"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    named = v.select(F.posexplode("v").alias("at", "x"), F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x["value"]).alias("total"), "size")
    met = named.join(ends, "at").select(F.col("x.id").alias("left_out"), "n", ((F.col("total") - F.col("x.value")) / F.col("n")).alias("mean"), F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    return met.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def stability(loo: DataFrame) -> DataFrame:
    """One row: n, surviving (intervals without zero) and hinges (ids that matter)."""
    hinges = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("excludes_zero"), F.col("left_out").cast("string")))), ",")
    return loo.agg(F.count("*").alias("n"), F.count_if("excludes_zero").alias("surviving"), hinges.alias("hinges"))


def underpowered(ci: DataFrame, least: int = 40, half_width: float = 0.05) -> DataFrame:
    """Groups too small, or with an interval too wide, for a comparison."""
    return ci.withColumn("underpowered", (F.col("n") < least) | ((F.col("hi") - F.col("lo")) / 2 > half_width))


# ---------------------------------------------------------------- NumPy's stream

#: Replicates, seed, and indices from ``default_rng(seed).integers(0, n, (replicates, n))``
#: group after group, which published intervals were drawn with.
STREAM = {"replicates": REPLICATES, "seed": SEED}
MOST_VALUES, BLOCK = 1_000_000, 1 << 22


def resampled(v: np.ndarray, generator: np.random.Generator, b: int) -> np.ndarray:
    """Means of ``b`` resamples; indices are drawn in blocks of rows, which leaves the stream as it is."""
    step = max(1, BLOCK // len(v))
    return np.concatenate([v[generator.integers(0, len(v), (min(step, b - at), len(v)))].mean(axis=1) for at in range(0, b, step)])


def stream_intervals(groups: list[np.ndarray], b: int = STREAM["replicates"], seed: int = STREAM["seed"], fresh: bool = False) -> np.ndarray:
    """n, mean and the ends of the 95 % interval of each group, from one generator or, if ``fresh``, one each.

    A group without values draws nothing and has zeros.
    """
    out, generator = np.zeros((len(groups), 4)), np.random.default_rng(seed)
    for row, v in zip(out, groups, strict=True):
        if fresh:
            generator = np.random.default_rng(seed)
        if len(v):
            row[:] = len(v), v.mean(), *np.quantile(resampled(v, generator, b), (0.025, 0.975))
    return out


def _by_group(values: DataFrame, keys: list[str]) -> dict[tuple, list[tuple]]:
    """(id, value) of each group in the order of id; the values, one a query, come to the driver."""
    rows = values.select(*keys, "id", "value").limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values; use bootstrap(), which doesn't collect them")
    out: dict[tuple, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        out.setdefault(tuple(r[k] for k in keys), []).append((r["id"], float(r["value"])))
    return out


def numpy_grid(values: DataFrame, order: list[tuple], keys: list[str], b: int = REPLICATES, seed: int = SEED, fresh: bool = False) -> DataFrame:
    """Intervals of several groups from one generator, drawn in the stated ``order``."""
    found = _by_group(values, keys)
    table = stream_intervals([np.array([v for _, v in found.get(tuple(g), [])]) for g in order], b, seed, fresh)
    rows = [(*map(str, g), int(n), float(mean), float(lo), float(hi), bool(lo <= 0 <= hi)) for g, (n, mean, lo, hi) in zip(order, table, strict=True)]
    return values.sparkSession.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + ", n int, mean double, lo double, hi double, includes_zero boolean")


def numpy_paired(values: DataFrame, order: list[tuple], keys: list[str], b: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Intervals of differences, a fresh generator each, with the intervals without one id in turn.

    keys, n, mean, lo, hi, excludes_zero; loo_surviving, how many of the loo_total
    intervals without one id exclude zero, and hinges, the ids of the others. As every
    interval has a generator of its own, they are dealt over the tasks.
    """
    spark = values.sparkSession
    import_path(spark)
    order = list(dict.fromkeys(map(tuple, order)))
    found = _by_group(values, keys)
    pairs = [found.get(tuple(g), []) for g in order]
    shared = spark.sparkContext.broadcast([(g, [str(i) for i, _ in p], np.array([x for _, x in p])) for g, p in zip(order, pairs, strict=True)])
    ends = np.cumsum([len(p) + 1 for p in pairs]) if pairs else np.zeros(0, int)

    def run(frames):
        for frame in frames:
            rows = []
            for unit in frame["id"]:
                which = int(np.searchsorted(ends, unit, "right"))
                g, ids, v = shared.value[which]
                left = int(unit - ends[which] + len(v))  # -1 for all values
                n, mean, lo, hi = stream_intervals([v if left < 0 else np.delete(v, left)], b, seed, True)[0]
                rows.append((*map(str, g), left, "" if left < 0 else ids[left], int(n), float(mean), float(lo), float(hi), not lo <= 0 <= hi))
            yield pd.DataFrame(rows, columns=[*keys, "left", "left_id", "n", "mean", "lo", "hi", "clear"])

    named = ", ".join(f"{k} string" for k in keys)
    units = spark.range(int(ends[-1]) if len(ends) else 0).repartition(spark.sparkContext.defaultParallelism)
    each = units.mapInPandas(run, f"{named}, left int, left_id string, n int, mean double, lo double, hi double, clear boolean")
    one = lambda c: F.max(F.when(F.col("left") < 0, F.col(c))).alias(c)
    without = F.col("left") >= 0
    hinges = F.array_sort(F.collect_list(F.when(without & ~F.col("clear"), F.struct("left", "left_id"))))
    out = each.groupBy(*keys).agg(*[one(c) for c in ("n", "mean", "lo", "hi")], one("clear").alias("excludes_zero"), F.count_if(without & F.col("clear")).cast("int").alias("loo_surviving"), F.count_if(without).cast("int").alias("loo_total"), F.array_join(F.transform(hinges, lambda h: h["left_id"]), ",").alias("hinges"))
    return out
