"""Corpus intake: normalise, merge, check, hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, indexed_text, whitespace_tokens


def normalise(raw: DataFrame) -> DataFrame:
    """Papers from raw search results; without bibcode or abstract they are dropped."""
    title = raw.schema["title"].dataType.typeName()
    first = F.try_element_at("title", F.lit(1)) if title == "array" else F.col("title")
    return raw.where("length(bibcode) > 0 and length(abstract) > 0").select(
        "bibcode",
        F.coalesce(first, F.lit("")).alias("title"),
        F.col("year").try_cast("int").alias("year"),
        F.coalesce("author", F.array().cast("array<string>")).alias("authors"),
        "abstract",
    )


def search(raw: DataFrame, year_start: int, limit: int, phrase: str | None = None) -> DataFrame:
    """The most cited papers from a year on, one for each bibcode, at most ``limit``."""
    found = raw.where(F.col("year").try_cast("int") >= year_start)
    if phrase:
        found = found.where(F.contains(F.lower("abstract"), F.lit(phrase.lower())))
    return keep_first(found, ["bibcode"], [F.col("citation_count").desc_nulls_last()]).orderBy(F.desc_nulls_last("citation_count"), "bibcode").limit(limit)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order.

    The rank filter is pushed into a group limit before the shuffle, so no more
    than one row of a key leaves each task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.select(F.struct("*").alias("row"), F.row_number().over(w).alias("place"))  # whatever the columns are called
    return numbered.where("place = 1").select("row.*")


def merge_keep_first(base: DataFrame, fetched: DataFrame, key: str = "bibcode") -> DataFrame:
    """``base`` and what ``fetched`` adds to it; rows of ``base`` win."""
    return base.unionByName(fetched.join(base.select(key), key, "left_anti").select(base.columns))


def merge_report(base: DataFrame, fetched: DataFrame, key: str = "bibcode") -> DataFrame:
    """One row: sizes, the overlap, and whether the merged keys hold all base keys."""
    sides = base.select(key, F.lit(1).alias("b"), F.lit(0).alias("f")).unionAll(fetched.select(key, F.lit(0), F.lit(1)))
    keys = sides.groupBy(key).agg(F.sum("b").alias("b"), F.sum("f").alias("f"))
    return keys.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_base"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("n_fetched"),
        F.count_if((F.col("b") > 0) & (F.col("f") > 0)).alias("n_overlap"),
        F.count("*").alias("n_merged"),
        (F.count_if((F.col("b") > 0)) <= F.count("*")).alias("superset"),
    )


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    a = left.select(key).distinct().withColumn("l", F.lit(True))
    b = right.select(key).distinct().withColumn("r", F.lit(True))
    met = a.join(b, key, "full_outer").where("l is null or r is null")
    return met.select(key, F.when(F.col("l").isNull(), "left").otherwise("right").alias("missing_in"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def chunks(papers: DataFrame) -> DataFrame:
    """One chunk a paper: its indexed text with id, section and token count."""
    text = indexed_text(F.col("title"), F.col("abstract"))
    return papers.select(
        chunk_id(F.col("bibcode")).alias("chunk_id"), "bibcode", F.lit("abstract").alias("section"), text.alias("content"), whitespace_tokens(text).alias("token_count"), F.lit(0).alias("chunk_index")
    )


def chunks_with_papers(chunked: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks with title and year of their paper; chunks without a paper are left out."""
    return chunked.join(papers.select("bibcode", "title", "year"), "bibcode")


def content_hash(papers: DataFrame) -> str:
    """``sha256:`` and the hash over key, tab, indexed text and line feed in key order.

    The definition is sequential: Spark sorts and builds the lines, the driver
    folds them one partition at a time. For large corpora use
    :func:`content_hash_tree`.
    """
    lines = papers.select("bibcode", F.concat("bibcode", F.lit("\t"), indexed_text(F.col("title"), F.col("abstract")), F.lit("\n")).alias("line")).orderBy("bibcode")
    digest = hashlib.sha256()
    for row in lines.select("line").toLocalIterator(prefetchPartitions=True):
        digest.update(row["line"].encode())
    return "sha256:" + digest.hexdigest()


def content_hash_tree(papers: DataFrame, digits: int = 3) -> DataFrame:
    """One row ``corpus_hash``: a hash over the hashes of 16**digits key buckets.

    Order-independent like :func:`content_hash`, and no task holds more than a
    bucket's line hashes; a null key counts as empty.
    """
    key = F.coalesce("bibcode", F.lit(""))
    line = F.sha2(F.concat(key, F.lit("\t"), indexed_text(F.col("title"), F.col("abstract"))), 256)
    leaves = papers.select(F.substring(F.sha2(key, 256), 1, digits).alias("b"), line.alias("h"))
    nodes = leaves.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return nodes.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda n: n["h"]), ""), 256)).alias("corpus_hash"))


def guard_output(path: str, frozen: str) -> None:
    """Refuses to write a merged corpus over the frozen one."""
    if path.rstrip("/") == frozen.rstrip("/"):
        raise ValueError(f"{path} is the frozen corpus; write the merged one elsewhere")


