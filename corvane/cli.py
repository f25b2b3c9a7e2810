"""Command line: python -m corvane.cli COMMAND ...

ingest, index, retrieve, evaluate, ablate, sweep, prepare, commit, build and status.
Papers and gold are JSON lines; vectors come as Parquet (doc_id, vector) and those of
queries as Parquet (query_id, vector) or, for one query, as a JSON list. ``train`` is
no command: models are trained elsewhere.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import functions as F

from .functions.text import default_example_id, indexed_text, kind_of
from .operators import contract, ingest, ireval, ranking, stats
from .plans import authoring, evaluation
from .session import get_session
from .sources import readers, writers
from .sources.schemas import ARMS, PAPER, RAW_PAPER


def _docs(corpus):
    return corpus.select(F.col("bibcode").alias("doc_id"), indexed_text(F.col("title"), F.col("abstract")).alias("text"))


def run_ingest(spark, a) -> int:
    papers = ingest.normalise(ingest.search(readers.read_jsonl(spark, a.raw, RAW_PAPER), a.year_start, a.limit, a.phrase))
    if a.merge_with:
        ingest.guard_output(a.output, a.merge_with)
        base = readers.load_snapshot(spark, a.merge_with)
        print(writers.markdown(ingest.merge_report(base, papers)))
        papers = ingest.merge_keep_first(base, papers)
    if not a.dry_run:
        writers.write_jsonl(papers, a.output)
    return 0


def run_index(spark, a) -> int:
    docs = _docs(readers.load_snapshot(spark, a.input))
    if not a.dry_run:
        ranking.build_index(docs, a.output, a.reset)
    return 0


def _top(spark, a, queries):
    """query_id, doc_id, score and the ranks of the arm that is asked for."""
    if a.arm == "lexical":
        top = ranking.search_index(queries, a.index, a.k)
        return top.withColumns({"dense_rank": F.lit(None).cast("int"), "lexical_rank": F.col("rank")})
    if not a.vectors or "vector" not in queries.columns:
        raise SystemExit("a dense arm needs --vectors and the vectors of the queries")
    vectors, pool = spark.read.parquet(a.vectors), max(50, a.k)
    dense = ranking.dense_topk(queries, vectors, a.k if a.arm == "dense" else pool)
    if a.arm == "dense":
        return dense.withColumns({"dense_rank": F.col("rank"), "lexical_rank": F.lit(None).cast("int")})
    return ranking.fuse(dense, ranking.search_index(queries, a.index, pool), a.k)


def _one_query(spark, a):
    vector = [float(x) for x in json.loads(a.query_vector)] if a.query_vector else None
    q = spark.createDataFrame([("q", a.query, vector)], "query_id string, query string, vector array<double>")
    return q if vector else q.drop("vector")


def run_retrieve(spark, a) -> int:
    for r in _top(spark, a, _one_query(spark, a)).orderBy("rank").collect():
        print(f"{r['doc_id']}\t{r['score']:.6f}")
    return 0


def _gold(queries):
    return queries.select("query_id", F.explode("gold").alias("doc_id"))


def _queries(spark, a):
    with open(a.queries, encoding="utf-8") as f:
        queries = readers.query_set(spark, f.read())
    return queries.join(spark.read.parquet(a.query_vectors), "query_id", "left") if a.query_vectors else queries


def run_evaluate(spark, a) -> int:
    queries = _queries(spark, a)
    ranks = _top(spark, a, queries).select("query_id", "doc_id", "dense_rank", "lexical_rank", F.col("rank").alias("hybrid_rank"))
    counted = ireval.accounting(queries, _gold(queries), F.lit("scored")).first()
    scored = ireval.per_query(ireval.gold_ranks(_gold(queries), ranks), a.k)
    print(writers.markdown(ireval.arm_table(scored, F.lit("scored")).where((F.col("arm") == a.arm) & (F.col("slice") == "all"))))
    print(f"{counted['n_scored']} scored, skipped: {', '.join(counted['skipped']) or 'none'}")
    return 0


def _report(spark, a, results) -> int:
    for name, table in results.items():
        print(f"### {name}\n\n{json.dumps(table) if isinstance(table, dict) else writers.markdown(table)}")
    if a.json_out:
        writers.write_results(results, a.json_out, spark)
    return 0


def run_ablate(spark, a) -> int:
    queries = _queries(spark, a)
    return _report(spark, a, evaluation.ablation(queries, _gold(queries), spark.read.parquet(a.vectors), a.index, kind_of(F.col("query_id")), a.k, a.pool, a.bootstrap, a.seed))


def run_sweep(spark, a) -> int:
    queries = _queries(spark, a)
    with open(a.partition, encoding="utf-8") as f:
        partition = readers.partition_set(spark, f.read())
    expected = spark.read.schema("pool int, slice string, union_recall double").json(a.expected) if a.expected else None
    try:
        results = evaluation.sweep(queries, _gold(queries), spark.read.parquet(a.vectors), a.index, partition, [int(p) for p in a.pools.split(",")], a.k, expected, a.bootstrap, a.seed)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return _report(spark, a, results)


def run_prepare(spark, a) -> int:
    corpus = readers.load_snapshot(spark, a.corpus, schema=PAPER)
    try:
        authoring.check_flags(a.family, a.partition, a.negative, a.negative_type)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if os.path.exists(a.out) and not (a.force or a.dry_run):
        print(f"{a.out} exists; --force overwrites it", file=sys.stderr)
        return 1
    q = _one_query(spark, a)
    frozen = ingest.content_hash(corpus)
    context = authoring.assemble_context(q, corpus, spark.read.parquet(a.vectors), frozen, datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")).orderBy("rank")
    rows = [{k: r[k] for k in ("bibcode", "chunk_id", "retrieval_score")} for r in context.collect()]
    name = a.example_id or spark.range(1).select(default_example_id(F.lit(a.family), F.lit(a.partition), F.lit(a.query), F.lit(a.negative))).first()[0]
    sheet = authoring.worksheet(name, a.query, a.family, a.partition, rows, frozen, a.negative, a.negative_type)
    shown = authoring.render_context(context, corpus, a.render_limit or authoring.POOL).first()
    print(shown["text"] if shown else "no context")
    if not a.dry_run:
        with open(a.out, "w", encoding="utf-8") as f:
            json.dump(sheet, f, indent=2, ensure_ascii=False)
    return 0


def run_commit(spark, a) -> int:
    try:
        authoring.commit(spark, authoring.read_worksheet(spark, a.sheet), a.gold, readers.load_snapshot(spark, a.corpus, schema=PAPER))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def run_build(spark, a) -> int:
    return 0 if authoring.build_manifest(spark, a.gold, readers.load_snapshot(spark, a.corpus, schema=PAPER), a.out) else 1


def run_status(spark, a) -> int:
    rows, errors = readers.load_gold(spark, a.gold)
    print(writers.markdown(contract.target_progress(contract.composition(rows)).orderBy("group")))
    print(f"{errors.count()} lines can't be read")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    sub = p.add_subparsers(required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, kw in options:
            c.add_argument(flag, **kw)

    need, dry = {"required": True}, ("--dry-run", {"action": "store_true"})
    command("ingest", run_ingest, ("--raw", need), ("--output", need), ("--year-start", {"type": int, "default": 2018}), ("--limit", {"type": int, "default": 500}), ("--phrase", {}), ("--merge-with", {}), dry)
    command("index", run_index, ("--input", need), ("--output", need), ("--reset", {"action": "store_true"}), dry)
    k, arm, vectors, json_out = ("--k", {"type": int, "default": 10}), ("--arm", {"choices": ARMS, "default": "lexical"}), ("--vectors", {}), ("--json-out", {})
    draws = (("--bootstrap", {"type": int, "default": stats.REPLICATES}), ("--seed", {"type": int, "default": stats.SEED}))
    command("retrieve", run_retrieve, ("query", {}), ("--index", need), k, arm, vectors, ("--query-vector", {}))
    command("evaluate", run_evaluate, ("--queries", need), ("--index", need), k, arm, vectors, ("--query-vectors", {}))
    command("ablate", run_ablate, ("--queries", need), ("--index", need), ("--vectors", need), ("--query-vectors", need), k, ("--pool", {"type": int, "default": 50}), *draws, json_out)
    command("sweep", run_sweep, ("--queries", need), ("--partition", need), ("--index", need), ("--vectors", need), ("--query-vectors", need), k, ("--pools", {"default": "50,100,200,500"}), ("--expected", {}), *draws, json_out)
    command(
        "prepare", run_prepare, ("--query", need), ("--query-vector", need), ("--vectors", need), ("--family", need), ("--partition", need), ("--negative", {"action": "store_true"}), ("--negative-type", {}),
        ("--example-id", {}), ("--corpus", need), ("--out", need), ("--render-limit", {"type": int}), ("--force", {"action": "store_true"}), dry,
    )
    command("commit", run_commit, ("--sheet", need), ("--gold", need), ("--corpus", need))
    command("build", run_build, ("--gold", need), ("--corpus", need), ("--out", need))
    command("status", run_status, ("--gold", need))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(get_session(), args)


if __name__ == "__main__":
    sys.exit(main())
