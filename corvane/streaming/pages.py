"""Resumable intake from a paged search API.

The stream's offsets are positions in the API's result list, so a query that is
started again goes on behind its last committed position. The source only deals out
pages, as (start, rows); tasks fetch them. Where the list ends is found by asking
for single rows, as an API answers an empty page behind its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..session import import_path
from ..sources.readers import available, named_function
from .ingest import append_once

PAGE = 200


class PagedStream(DataSource):
    """Pages of an API as a stream of (start, rows).

    Options: ``fetch`` (module:function of (start, rows) -> list of JSON objects),
    ``page`` rows a page, ``pages`` a batch, ``limit`` rows in all.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def schema(self) -> str:
        return "start long, rows int"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Pages(self.options)


class _Pages(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.fetch, self.page = named_function(options["fetch"]), min(PAGE, int(options.get("page", PAGE)))
        self.batch, self.limit = int(options.get("pages", "64")) * self.page, int(options.get("limit", str(1 << 62)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = start["at"] + available(self.fetch, start["at"], min(self.batch, self.limit - start["at"]))
        return self.readBetweenOffsets(start, {"at": end}), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(at, min(self.page, end["at"] - at)) for at in range(start["at"], end["at"], self.page)])


def page_stream(spark: SparkSession, fetch: str, schema: str | StructType, page: int = PAGE, pages: int = 64, limit: int | None = None) -> DataFrame:
    """The API's objects as a stream, with their position ``seq`` in the result list.

    A page with fewer objects than asked for is an error, as the rest would be lost.
    """
    spark.dataSource.register(PagedStream)
    import_path(spark)
    source = spark.readStream.format("paged_stream").option("fetch", fetch).option("page", page).option("pages", pages)
    dealt = (source if limit is None else source.option("limit", limit)).load()

    def run(batches):
        get = named_function(fetch)
        for batch in batches:
            for start, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = get(start, rows)
                if len(found) != rows:
                    raise ValueError(f"{len(found)} of {rows} rows from {start} on")
                yield pa.RecordBatch.from_arrays([pa.array(range(start, start + rows), pa.int64()), pa.array([json.dumps(x, ensure_ascii=False) for x in found], pa.string())], names=["seq", "doc"])

    dealt = dealt.repartition(min(pages, spark.sparkContext.defaultParallelism))
    return dealt.mapInArrow(run, "seq long, doc string").select("seq", F.from_json("doc", schema).alias("d")).select("seq", "d.*")


def ingest_pages(spark: SparkSession, fetch: str, schema: str | StructType, key: str, target: str, checkpoint: str, page: int = PAGE, pages: int = 64, limit: int | None = None) -> int:
    """Append every object whose ``key`` hasn't been seen to ``target``, until a page is empty; returns the batches run.

    A run that was stopped goes on from its checkpoint: what it has committed isn't
    fetched again, and what it hasn't is written once, as the sink is transactional.
    """
    batches = 0
    while True:
        query = append_once(page_stream(spark, fetch, schema, page, pages, limit), key, target, checkpoint)
        query.awaitTermination()
        read = sum(p["numInputRows"] for p in query.recentProgress)
        if not read:
            return batches
        batches += 1
