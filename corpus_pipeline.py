"""The corpus pipeline: five stages, each over all that the one before it kept.

``run`` writes every stage as Parquet into the shared folder and reads it again
as the next one's documents; a stage's table goes when the next one is written.
All stages but the last return the columns of ``documents``; the last adds nothing
but draws the sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, jaccard, linededup, mixing, toxicity
from corvane.session import materialize, release, tidy

#: Near copies share five-word shingles at a similarity of 0.8 or more.
NEAR_COPIES = jaccard.Rule(width=5, num=80, den=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in one of them."""
    return linededup.drop_repeats(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs, NEAR_COPIES)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the target weights."""
    return mixing.sample(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_copies", join_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: SQL can't express the toxicity model; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
        tidy(spark)
    return docs
