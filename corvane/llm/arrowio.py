"""Arrow batches of bounded size for Python stages.

The stages here set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to
``BATCH_ROWS`` at most: a batch of Spark's default of 10,000 documents takes
tens of megabytes in the JVM and again in each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import import_path


BATCH_ROWS = 1000
_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded size; unused memory goes back after a task."""
    import_path(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_LIMIT)) <= BATCH_ROWS:
        conf.set(_LIMIT, str(BATCH_ROWS))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, decoded a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 2000, weight: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``limit`` rows, or of ``limit`` in ``weight``."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row) if weight else 1
        if load >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, load = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], Iterator[tuple]]], schema: str | StructType, limit: int = 500, weight: Callable | None = None) -> DataFrame:
    """Apply ``make()``, called once a task, to each row; it yields output rows, batched by ``limit`` in rows or ``weight``."""
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        each = make()
        return batched((out for row in rows_of(batches) for out in each(row)), arrow, limit, weight)

    return map_arrow(df, run, target)


def text_groups(batches: Iterator[pa.RecordBatch], text: int, size: int = 1 << 18) -> Iterator[list[tuple]]:
    """Lists of rows whose texts have up to ``size`` characters together, or one row."""
    held, load = [], 0
    for row in rows_of(batches):
        n = len(row[text] or "") + 64
        if held and load + n > size:
            yield held
            held, load = [], 0
        held.append(row)
        load += n
    if held:
        yield held


def map_texts(df: DataFrame, text: int, make: Callable[[], Callable[[list[tuple]], Iterator[tuple]]], schema: str | StructType, limit: int = 500, size: int = 1 << 18) -> DataFrame:
    """Like :func:`map_rows`, for many rows at once.

    Rows are handed over when the texts in column number ``text`` reach
    ``size`` characters together, so a batch holds one long text at most.
    """
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        each = make()
        return batched((out for rows in text_groups(batches, text, size) for out in each(rows)), arrow, limit)

    return map_arrow(df, run, target)
