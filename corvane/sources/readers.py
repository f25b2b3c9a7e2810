"""Scans: JSON lines, snapshots with guards, tolerant gold files, query sets, JDBC, paged APIs."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .schemas import GOLD, PAPER


def read_jsonl(spark: SparkSession, path: str, schema: str = PAPER) -> DataFrame:
    """One JSON object a line under an explicit schema; blank lines are skipped.

    A line that is no JSON of this schema raises when it is read.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_snapshot(spark: SparkSession, path: str, key: str = "bibcode", schema: str = PAPER) -> DataFrame:
    """A corpus with guards: a missing file, no rows, missing or repeated keys raise."""
    df = read_jsonl(spark, path, schema)
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total, missing, repeated = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.coalesce(F.col(key), F.lit("")) == ""), F.count_if(F.col("n") > 1)).first()
    if not total:
        raise ValueError(f"corpus {path} is empty")
    if missing:
        raise ValueError(f"corpus {path}: a record has no {key}")
    if repeated:
        raise ValueError(f"corpus {path}: {repeated} {key} values occur more than once")
    return df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of a text file.

    Line numbers need the number of lines in all splits before one, so a first
    pass counts them; the counts, one a split, are all that meets in one place.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    offsets = lines.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.join(F.broadcast(offsets), "p").select((F.col("before") + at + 1).alias("line_no"), "line")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with line_no, errors with line_no and message); a missing file has neither.

    Only the JSON is judged here; :mod:`corvane.operators.contract` judges the rows.
    """
    if not exists(spark, path):
        none = spark.createDataFrame([], StructType.fromDDL(f"line_no long, {GOLD}"))
        return none, spark.createDataFrame([], "line_no long, message string")
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("ok", F.expr("try_parse_json(line)").isNotNull() & F.trim("line").startswith("{"))
    rows = parsed.where("ok").select("line_no", F.from_json("line", GOLD).alias("r")).select("line_no", "r.*")
    errors = parsed.where("not ok").select("line_no", F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": invalid JSON")).alias("message"))
    return rows, errors


def parse_document(text: str):
    """YAML, or JSON where there is no YAML parser."""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text)
    return yaml.safe_load(text)


def parse_query_set(text: str) -> list[dict]:
    """Records of a query set: a list, or a mapping with ``queries``."""
    data = parse_document(text)
    return data["queries"] if isinstance(data, dict) else data


def query_set(spark: SparkSession, text: str) -> DataFrame:
    """query_id, target, query and gold (array) of a query set."""
    rows = [(str(q["id"]), q.get("target"), q["query"], [str(b) for b in q.get("expected_bibcodes") or []]) for q in parse_query_set(text)]
    return spark.createDataFrame(rows, "query_id string, target string, query string, gold array<string>")


def partition_set(spark: SparkSession, text: str) -> DataFrame:
    """query_id, slice and gold of a committed partition (slice -> query -> gold)."""
    data = parse_document(text)
    rows = []
    for label in ("known_item", "broad_entity", "unscored"):
        entries = data.get(label) or {}
        for query_id, gold in entries.items() if isinstance(entries, dict) else ((q, []) for q in entries):
            rows.append((str(query_id), label, [str(b) for b in ([gold] if isinstance(gold, str) else gold or [])]))
    return spark.createDataFrame(rows, "query_id string, slice string, gold array<string>")


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, splits: int = 8, **options: str) -> DataFrame:
    """A query of a database, read in ranges of ``key`` where bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key and bounds:
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", splits).load()
    return reader.option("query", query).load()


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content (binary) of every file, e.g. archives of TeX or PDF."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


class PagedSource(DataSource):
    """Rows of a paged search API, one split a page.

    ``fetch`` is a function (start, rows) -> list of JSON objects, given under a
    name as ``module:function``; ``limit`` and ``page`` bound the pages.
    ``streaming.pages`` has the resumable form.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "seq long, doc string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.limit, self.page = options["fetch"], int(options.get("limit", "500")), min(200, int(options.get("page", "200")))

    def partitions(self):
        # without rows a split of its own, as Spark wants one
        return [InputPartition((start, min(self.page, self.limit - start))) for start in range(0, max(1, self.limit), self.page)]

    def read(self, partition) -> Iterator[tuple]:
        start, rows = partition.value
        for i, doc in enumerate(named_function(self.fetch)(start, rows) if rows else ()):
            yield start + i, json.dumps(doc, ensure_ascii=False)


def named_function(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def available(fetch: Callable[[int, int], list], start: int, most: int) -> int:
    """How many rows an API has from ``start`` on, ``most`` at most, by single rows in log2(most) calls."""
    if most <= 0 or fetch(start + most - 1, 1):
        return max(0, most)
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        if fetch(start + middle - 1, 1):
            low = middle
        else:
            high = middle
    return low


def read_paged(spark: SparkSession, fetch: str, schema: str, limit: int = 500, page: int = 200) -> DataFrame:
    """The pages' objects with their position ``seq`` in the result list, up to ``limit`` or its end."""
    spark.dataSource.register(PagedSource)
    held = available(named_function(fetch), 0, limit)
    raw = spark.read.format("paged_api").option("fetch", fetch).option("limit", held).option("page", page).load()
    return raw.select("seq", F.from_json("doc", schema).alias("d")).select("seq", "d.*")
