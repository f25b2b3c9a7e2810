"""Retrieval evaluation: recall, reciprocal rank, tags, unions, pool sweeps.

Gold is a table query_id, doc_id (repeats count as often as they occur);
queries without gold are not scored. Ranks are null where a document is not
retrieved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RRF_K
from .ranking import ranked

ARM_RANKS = {"dense": "dense_rank", "lexical": "lexical_rank", "hybrid": "hybrid_rank"}


def with_hybrid(full: DataFrame, pool: int, decimals: int = 9) -> DataFrame:
    """Ranks cut at ``pool`` and fused; only documents in one of the pools."""
    cut = lambda c: F.when(F.col(c) <= pool, F.col(c))
    kept = full.select("query_id", "doc_id", cut("dense_rank").alias("dense_rank"), cut("lexical_rank").alias("lexical_rank")).where("dense_rank is not null or lexical_rank is not null")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col(c)), F.lit(0.0))
    scored = kept.withColumn("score", F.round(part("dense_rank") + part("lexical_rank"), decimals))
    order = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.col("doc_id")]
    return ranked(scored, order, None, "hybrid_rank").drop("score")


def gold_ranks(gold: DataFrame, ranks: DataFrame) -> DataFrame:
    """Every gold pair with its ranks (null: not retrieved)."""
    return gold.join(ranks, ["query_id", "doc_id"], "left")


def tag(dense: Column, lexical: Column) -> Column:
    return F.when(dense.isNotNull() & lexical.isNotNull(), "both").when(dense.isNotNull(), "dense_only").when(lexical.isNotNull(), "lexical_only").otherwise("neither")


def per_query(found: DataFrame, k: int) -> DataFrame:
    """One row a query: n_gold; recall, reciprocal rank and first hit of each arm at
    ``k``; recall of each arm and of the union over the whole ranks; tags."""
    hits = lambda c, cut=None: F.count_if(F.col(c) <= cut if cut else F.col(c).isNotNull())
    n = F.count("*")
    cells = [n.alias("n_gold")]
    for arm, c in ARM_RANKS.items():
        first = F.min(F.when(F.col(c) <= k, F.col(c)))
        cells += [
            (hits(c, k) / n).alias(f"{arm}_recall"),
            F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias(f"{arm}_rr"),
            first.alias(f"{arm}_first"),
            (hits(c) / n).alias(f"{arm}_recall_pool"),
        ]
    t = tag(F.col("dense_rank"), F.col("lexical_rank"))
    cells += [F.count_if(t == x).alias(x) for x in ("dense_only", "lexical_only", "both", "neither")]
    cells += [(F.count_if(t != "neither") / n).alias("union_recall")]
    return found.groupBy("query_id").agg(*cells)


def labelled(rows: DataFrame, label: Column | DataFrame) -> DataFrame:
    """``rows`` with ``own``: an expression over query_id, or the slice of a table (query_id, slice)."""
    if isinstance(label, DataFrame):
        return rows.join(label.select("query_id", F.col("slice").alias("own")), "query_id", "left")
    return rows.withColumn("own", label)


def sliced(rows: DataFrame, label: Column | DataFrame) -> DataFrame:
    """Every row in slice ``all`` and in the slice of its label (see :func:`labelled`)."""
    return labelled(rows, label).withColumn("slice", F.explode(F.array(F.lit("all"), F.col("own")))).drop("own")


def arm_table(scored: DataFrame, label: Column) -> DataFrame:
    """slice, arm, n, recall and mrr: means over queries."""
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_recall").alias("recall"), F.col(f"{a}_rr").alias("rr"), F.col(f"{a}_recall_pool").alias("pool_recall")) for a in ARM_RANKS]))
    long = sliced(scored, label).select("slice", arms.alias("m")).select("slice", "m.*")
    return long.groupBy("slice", "arm").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("pool_recall").alias("pool_recall"))


def complementarity(scored: DataFrame, label: Column) -> DataFrame:
    """slice, documents by tag, union recall and its gain over the dense arm."""
    s = sliced(scored, label).groupBy("slice")
    tags = [F.sum(x).alias(x) for x in ("dense_only", "lexical_only", "both", "neither")]
    return s.agg(*tags, F.avg("union_recall").alias("union_recall"), F.avg("dense_recall_pool").alias("dense_recall")).withColumn("gain", F.col("union_recall") - F.col("dense_recall"))


def candidates(ranks: DataFrame) -> DataFrame:
    """query_id and the number of documents in the union of the pools."""
    return ranks.groupBy("query_id").agg(F.count("*").alias("n_candidates"))


def decisive(scored: DataFrame) -> DataFrame:
    """Queries on which the arms disagree about any hit within the cut."""
    hit = F.array(*[F.col(f"{a}_first").isNotNull() for a in ARM_RANKS])
    return scored.where(F.size(F.array_distinct(hit)) > 1)


def best_gold_rank(gold: DataFrame, *arms: DataFrame) -> DataFrame:
    """query_id and the best rank of its gold in every arm, at any depth.

    ``arms`` are tables of best ranks (``ranking.best_ranks`` and its like); null
    where an arm does not score any gold.
    """
    out = gold.select("query_id").distinct()
    for best in arms:
        out = out.join(best, "query_id", "left")
    return out


def pool_sweep(full: DataFrame, gold: DataFrame, pools: list[int], label: Column | DataFrame, cuts: tuple[int, int] = (10, 50)) -> DataFrame:
    """pool, slice: union recall, fused recall at both cuts, gaps, tags, candidates.

    One pass over the rankings: every row is copied into the pools it belongs to.
    """
    low, high = cuts
    top = max(pools)
    cut = full.where(f"dense_rank <= {top} or lexical_rank <= {top}")
    copies = cut.withColumn("pool", F.explode(F.array(*[F.lit(p) for p in pools])))
    within = copies.select(
        F.struct("query_id", "pool").alias("query_id"),
        "doc_id",
        F.when(F.col("dense_rank") <= F.col("pool"), F.col("dense_rank")).alias("dense_rank"),
        F.when(F.col("lexical_rank") <= F.col("pool"), F.col("lexical_rank")).alias("lexical_rank"),
    )
    fused = with_hybrid(within, top)
    pairs = gold.withColumn("pool", F.explode(F.array(*[F.lit(p) for p in pools]))).select(F.struct("query_id", "pool").alias("query_id"), "doc_id")
    found = gold_ranks(pairs, fused)
    t = tag(F.col("dense_rank"), F.col("lexical_rank"))
    n = F.count("*")
    scored = found.groupBy("query_id").agg(
        (F.count_if(t != "neither") / n).alias("union_recall"),
        (F.count_if(F.col("hybrid_rank") <= low) / n).alias("fused_low"),
        (F.count_if(F.col("hybrid_rank") <= high) / n).alias("fused_high"),
        *[F.count_if(t == x).alias(x) for x in ("dense_only", "lexical_only", "both", "neither")],
    )
    met = scored.join(candidates(fused), "query_id", "left").select("query_id.query_id", "query_id.pool", *scored.columns[1:], F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
    return sliced(met, label).groupBy("pool", "slice").agg(
        F.count("*").alias("n"),
        F.avg("union_recall").alias("union_recall"),
        F.avg("fused_low").alias("fused_low"),
        F.avg("fused_high").alias("fused_high"),
        F.avg(F.col("union_recall") - F.col("fused_low")).alias("gap_low"),
        F.avg(F.col("union_recall") - F.col("fused_high")).alias("gap_high"),
        *[F.sum(x).alias(x) for x in ("dense_only", "lexical_only", "both", "neither")],
        F.avg("n_candidates").alias("mean_candidates"),
    )


def ndcg(found: DataFrame, rank: str, k: int) -> DataFrame:
    """query_id and nDCG at ``k`` with binary relevance."""
    gain = F.sum(F.when(F.col(rank) <= k, F.lit(1.0) / F.log2(F.col(rank) + F.lit(1.0))).otherwise(F.lit(0.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count("*"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    return found.groupBy("query_id").agg((gain / ideal).alias("ndcg"))


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1; 0 where a share has no base."""
    c = lambda cond: F.count_if(cond)
    out = df.agg(c(truth & said).alias("tp"), c(~truth & said).alias("fp"), c(truth & ~said).alias("fn"), c(~truth & ~said).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return out.withColumns({
        "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def frozen_gate(measured: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 5e-4) -> DataFrame:
    """The rows of ``expected`` that ``measured`` misses by more than the tolerance."""
    want = expected.select(*keys, F.col(value).alias("want"))
    return want.join(measured.select(*keys, F.col(value).alias("got")), keys, "left").where(F.coalesce(F.abs(F.col("got") - F.col("want")), F.lit(1.0)) > tolerance)


def accounting(queries: DataFrame, gold: DataFrame, label: Column | DataFrame) -> DataFrame:
    """One row: n_scored, n_by_label (map) and skipped, the sorted ids of queries without gold.

    ``label`` is that of :func:`labelled`; a null one counts as ``(none)``.
    """
    scored = gold.where("doc_id is not null").select("query_id").distinct().withColumn("scored", F.lit(True))
    known = labelled(queries.select("query_id").distinct().join(scored, "query_id", "left"), label)
    rows = known.select("query_id", F.coalesce("scored", F.lit(False)).alias("scored"), F.coalesce("own", F.lit("(none)")).alias("label"))
    counts = rows.where("scored").groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("n_by_label"))
    return rows.agg(F.count_if("scored").alias("n_scored"), F.array_sort(F.collect_list(F.when(~F.col("scored"), F.col("query_id").cast("string")))).alias("skipped")).join(counts)


def partitioned(scored: DataFrame, partition: DataFrame) -> DataFrame:
    """``scored`` with the slice of ``partition`` (query_id, slice); an error names queries without one."""
    met = scored.join(partition.select("query_id", "slice"), "query_id", "left")
    missing = sorted(str(r["query_id"]) for r in met.where("slice is null").select("query_id").limit(5).collect())
    if missing:
        raise ValueError(f"queries without a slice in the committed partition: {', '.join(missing)}")
    return met


def diverging(partition: DataFrame, gold: DataFrame, label: str) -> DataFrame:
    """query_id of the committed entries of a slice whose list (gold) isn't the frozen one."""
    frozen = gold.select("query_id", F.col("gold").alias("frozen"))
    mine = partition.where(F.col("slice") == label).select("query_id", "gold")
    return mine.join(frozen, "query_id", "left").where(~F.col("gold").eqNullSafe(F.col("frozen"))).select("query_id")


def require(measured: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 5e-4) -> None:
    """Raise unless every row of ``expected`` is met; to be called before anything is written."""
    bad = frozen_gate(measured, expected, keys, value, tolerance).limit(5).collect()
    if bad:
        raise ValueError("frozen numbers are not met: " + "; ".join(f"{'/'.join(str(r[k]) for k in keys)}: got {r['got']}, not {r['want']}" for r in bad))


def refusals(df: DataFrame, answerable: Column, refused: Column, cap: float = 0.10) -> DataFrame:
    """One row: n answerable rows, the share of them refused (0 without any) and whether it keeps to the cap."""
    out = df.where(answerable).agg(F.count("*").alias("n"), F.coalesce(F.avg(refused.cast("int")), F.lit(0.0)).alias("false_refusal_rate"))
    return out.withColumn("within_cap", F.col("false_refusal_rate") <= cap)
