"""Authoring of gold records: frozen context, worksheets, commits.

A worksheet is a mapping with a locked part, filled by :func:`prepare`, and the
fields that a person fills in before :func:`commit`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_id, config_fingerprint, run_id
from ..operators import contract, ranking
from ..operators.ingest import content_hash, key_difference
from ..sources import readers, writers
from ..sources.schemas import GOLD, NEGATIVE_TYPES, PARTITIONS, TASK_FAMILIES

POOL = 100
CONFIG = {"arm": "hybrid", "k": POOL, "pool": POOL}


def guard_index(corpus: DataFrame, *indexes: DataFrame) -> None:
    """Every index holds exactly the corpus' keys, or an error names some that differ."""
    for index in indexes:
        wrong = key_difference(corpus.select("bibcode"), index.select("bibcode"), "bibcode")
        some = [f"{r['bibcode']} ({r['missing_in']})" for r in wrong.orderBy("bibcode").limit(5).collect()]
        if some:
            raise ValueError(f"index and corpus differ: {', '.join(some)}")


def assemble_context(queries: DataFrame, corpus: DataFrame, vectors: DataFrame, corpus_hash: str, stamp: str) -> DataFrame:
    """Top 100 of each query with chunk ids and the provenance of the run."""
    docs = corpus.select(F.col("bibcode").alias("doc_id"), F.concat_ws(". ", "title", "abstract").alias("text"))
    top = ranking.retrieve(queries, docs, vectors, "hybrid", POOL, POOL)
    return top.select(
        "query_id", "rank", F.col("doc_id").alias("bibcode"), chunk_id(F.col("doc_id")).alias("chunk_id"), F.col("score").alias("retrieval_score"),
        F.lit(corpus_hash).alias("corpus_hash"), F.lit(config_fingerprint(CONFIG)).alias("config"), F.lit(run_id(CONFIG, corpus_hash, stamp)).alias("run_id"),
    )


def render_context(context: DataFrame, corpus: DataFrame, most: int = 10) -> DataFrame:
    """query_id and text: the first ``most`` results with title and abstract."""
    top = context.where(F.col("rank") <= most).join(corpus.select("bibcode", "title", "abstract"), "bibcode")
    line = F.format_string("[%d] %s  %s\n%s", F.col("rank"), F.col("bibcode"), F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return top.groupBy("query_id").agg(F.array_join(lines, "\n\n").alias("text"))


def check_flags(family: str, partition: str, negative: bool, negative_type: str | None) -> None:
    """The rules of a worksheet's options."""
    for value, domain in ((family, TASK_FAMILIES), (partition, PARTITIONS)):
        if value not in domain:
            raise ValueError(f"{value!r} is none of {', '.join(domain)}")
    if negative and (partition != "calibration" or family == "abstention"):
        raise ValueError("a negative belongs to the calibration partition and is no abstention")
    if negative and negative_type not in NEGATIVE_TYPES:
        raise ValueError(f"a negative has a type: {', '.join(NEGATIVE_TYPES)}")
    if not negative and negative_type:
        raise ValueError("only a negative has a type")


def worksheet(example_id: str, query: str, family: str, partition: str, context: list[dict], corpus_hash: str, negative: bool = False, negative_type: str | None = None) -> dict:
    """A sheet with its locked part and empty fields."""
    check_flags(family, partition, negative, negative_type)
    claim = {"text": "", "cited_bibcode": None if family == "abstention" else "", "support_span": None, "supported": not negative}
    locked = {"example_id": example_id, "query": query, "task_family": family, "partition": partition, "is_negative": negative, "retrieved_context": context, "provenance": {"corpus_hash": corpus_hash}}
    return {"_locked": locked, "answer": "", "claims": [claim], "abstention_reason": None, "negative_type": negative_type}


def read_worksheet(spark: SparkSession, path: str) -> dict:
    """A worksheet from a JSON or YAML file; it has to have its locked part."""
    with open(path, encoding="utf-8") as f:
        sheet = readers.parse_document(f.read())
    if not isinstance(sheet, dict) or "_locked" not in sheet:
        raise ValueError("no worksheet: it has no locked part")
    return sheet


def commit(spark: SparkSession, sheet: dict, gold_path: str, corpus: DataFrame, corpus_hash: str | None = None) -> None:
    """Validate a filled sheet and append it; raises without writing otherwise."""
    if "_locked" not in sheet:
        raise ValueError("no worksheet: it has no locked part")
    record = {**{k: v for k, v in sheet.items() if k != "_locked"}, **sheet["_locked"]}
    now = corpus_hash or content_hash(corpus)
    if record["provenance"].get("corpus_hash") != now:
        raise ValueError("the corpus has changed since the sheet was prepared")
    schema = spark.createDataFrame([], GOLD).schema
    row = spark.createDataFrame([{f.name: record.get(f.name) for f in schema}], schema)
    errors = [r["message"] for r in contract.findings(row, corpus).where("level = 'error'").collect()]
    if errors:
        raise ValueError("; ".join(errors))
    if not writers.append_new(row, gold_path, "example_id"):
        raise ValueError(f"{record['example_id']} is in the gold file")


def build_manifest(spark: SparkSession, gold_path: str, corpus: DataFrame, out: str) -> bool:
    """Write the manifest of a gold file; whether it is valid."""
    rows, errors = readers.load_gold(spark, gold_path)
    m = contract.manifest(rows.drop("line_no"), corpus, content_hash(corpus), CONFIG, errors)
    return writers.write_manifest(m, out)["valid"]
