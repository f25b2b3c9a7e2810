"""Evaluation runs over a built index: ablation of the arms and a sweep of pool depths.

Both return report tables by name. Queries are query_id, query and, for dense arms,
vector; gold is query_id, doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ireval, ranking, stats
from ..session import materialize

PAIRS = {"dense_minus_hybrid": ("dense", "hybrid"), "lexical_minus_hybrid": ("lexical", "hybrid"), "dense_minus_lexical": ("dense", "lexical")}
SLICES, METRICS = ("named", "broad", "all"), ("recall", "rr")


def index_of(queries: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    """The postings of the queries' terms, and (n, avgdl), from the last version of a built index."""
    return ranking.index_postings(queries, path)


def values_of(scored: DataFrame, label: Column, pairs: bool = False) -> DataFrame:
    """arm (or pair), slice, metric, id and value of every scored query; a scratch table."""
    names = PAIRS if pairs else {a: (a, None) for a in ireval.ARM_RANKS}
    value = lambda x, y, m: F.col(f"{x}_{m}") - F.col(f"{y}_{m}") if y else F.col(f"{x}_{m}")
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(m).alias("metric"), value(*xy, m).alias("value")) for a, xy in names.items() for m in METRICS]))
    long = ireval.sliced(scored, label).select(F.col("query_id").alias("id"), "slice", cells.alias("c"))
    return materialize(long.select("c.arm", "slice", "c.metric", "id", "c.value"), "values")


def grid(scored: DataFrame, label: Column, b: int = stats.REPLICATES, seed: int = stats.SEED) -> DataFrame:
    """Intervals of arms, then pairs, by slice and metric, all from one generator."""
    values = values_of(scored, label).unionAll(values_of(scored, label, pairs=True))
    order = [(a, s, m) for names in (ireval.ARM_RANKS, PAIRS) for a in names for s in SLICES for m in METRICS]
    return stats.numpy_grid(values, order, ["arm", "slice", "metric"], b, seed)


def pool_values(heads: DataFrame, gold: DataFrame, pools: list[int], k: int) -> DataFrame:
    """pool, pair, id and value: the recall of an arm less that of the hybrid arm, at every pool."""
    rows = None
    for pool in pools:
        scored = ireval.per_query(ireval.gold_ranks(gold, ireval.with_hybrid(heads, pool)), k)
        part = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), (F.col(f"{x}_recall") - F.col("hybrid_recall")).alias("value")) for p, (x, y) in PAIRS.items() if y == "hybrid"]))
        long = scored.select(F.col("query_id").alias("id"), F.lit(str(pool)).alias("pool"), part.alias("c")).select("pool", "c.pair", "id", "c.value")
        rows = long if rows is None else rows.unionAll(long)
    return rows


def pool_intervals(heads: DataFrame, gold: DataFrame, pools: list[int], k: int, b: int = stats.REPLICATES, seed: int = stats.SEED) -> DataFrame:
    order = [(str(p), name) for p in pools for name, (_, y) in PAIRS.items() if y == "hybrid"]
    return stats.numpy_paired(pool_values(heads, gold, pools, k), order, ["pool", "pair"], b, seed)


def ablation(queries: DataFrame, gold: DataFrame, vectors: DataFrame, index: str, label: Column, k: int = 10, pool: int = 50, b: int = stats.REPLICATES, seed: int = stats.SEED) -> dict[str, DataFrame | dict]:
    """aggregates, complementarity, bootstrap, per_query, decisive and config."""
    heads = ranking.head_rankings(queries, vectors, *index_of(queries, index), pool)
    scored = materialize(ireval.per_query(ireval.gold_ranks(gold, ireval.with_hybrid(heads, pool)), k), "scored")
    counted = ireval.accounting(queries, gold, label).first()
    return {
        "config": {"k": k, "pool": pool, "B": b, "seed": seed, "n_scored": counted["n_scored"], "n_by_label": counted["n_by_label"], "skipped": counted["skipped"]},
        "aggregates": ireval.arm_table(scored, label).orderBy("slice", "arm"),
        "complementarity": ireval.complementarity(scored, label).orderBy("slice"),
        "bootstrap": grid(scored, label, b, seed),
        "per_query": scored.orderBy("query_id"),
        "decisive": ireval.decisive(scored).select("query_id", "dense_first", "lexical_first", "hybrid_first").orderBy("query_id"),
    }


def sweep(
    queries: DataFrame, gold: DataFrame, vectors: DataFrame, index: str, partition: DataFrame, pools: list[int], k: int = 10, expected: DataFrame | None = None, b: int = stats.REPLICATES, seed: int = stats.SEED
) -> dict[str, DataFrame | dict]:
    """pools, bootstrap and config; raises before anything is emitted.

    Every scored query needs a slice, committed known items must equal the gold, and
    ``expected`` (pool, slice, union_recall), where it is given, must be met.
    """
    lists = gold.groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("gold"))
    known = partition.where("slice = 'known_item'").select("query_id", "slice", F.sort_array("gold").alias("gold"))
    wrong = [str(r["query_id"]) for r in ireval.diverging(known, lists, "known_item").limit(5).collect()]
    if wrong:
        raise ValueError(f"the committed list differs from the frozen gold: {', '.join(sorted(wrong))}")
    slices = ireval.partitioned(gold.select("query_id").distinct(), partition)
    label = materialize(slices.select("query_id", "slice").distinct(), "slices")
    heads = ranking.head_rankings(queries, vectors, *index_of(queries, index), max(pools))
    table = materialize(ireval.pool_sweep(heads, gold, pools, label), "pools")
    if expected is not None:
        ireval.require(table, expected, ["pool", "slice"], "union_recall")
    counted = ireval.accounting(queries, gold, label).first()
    return {
        "config": {"k": k, "pools": pools, "B": b, "seed": seed, "n_scored": counted["n_scored"], "n_by_label": counted["n_by_label"], "skipped": counted["skipped"]},
        "pools": table.orderBy("pool", "slice"),
        "bootstrap": pool_intervals(heads, gold, pools, k, b, seed),
    }
