"""Sinks: JSON lines, tables with an overwrite guard, appends, manifests, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite ``path`` with JSON lines; null fields are written too."""
    out = df if files is None else df.coalesce(files)
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, reset: bool = False) -> None:
    """A Parquet table; a populated one is refused unless ``reset``."""
    df.write.mode("overwrite" if reset else "errorifexists").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose ``key`` is not there yet; returns how many there were."""
    spark = df.sparkSession
    if exists(spark, path):
        known = spark.read.schema(df.schema).json(path).select(key)
        df = df.join(known, key, "left_anti").select(df.columns)
    df = df.dropDuplicates([key])
    fresh = df.count()
    if fresh:
        df.write.mode("append").option("ignoreNullFields", "false").json(path)
    return fresh


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, through the file system that ``path`` names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_results(tables: dict[str, DataFrame | dict], path: str, spark: SparkSession) -> dict:
    """Small report tables and settings as one indented JSON file."""
    rows = lambda df: [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    data = {name: rows(t) if isinstance(t, DataFrame) else t for name, t in tables.items()}
    put_text(spark, json.dumps(data, indent=2, ensure_ascii=False) + "\n", path)
    return data


def write_eval_results(scores: DataFrame, path: str) -> None:
    """Append model, benchmark, score, details and run_at (now, where there is none) to the table of results."""
    from .schemas import EVAL_RESULTS

    names = [c.split()[0] for c in EVAL_RESULTS.replace("decimal(6,3)", "decimal").split(", ")]
    for name in set(names) - set(scores.columns):
        scores = scores.withColumn(name, F.current_timestamp() if name == "run_at" else F.lit(None).cast("string"))
    typed = scores.select("model", "benchmark", F.col("score").cast("decimal(6,3)").alias("score"), "details", F.col("run_at").cast("timestamp").alias("run_at"))
    typed.write.mode("append").parquet(path)


def write_package(rows: DataFrame, path: str) -> dict:
    """JSON lines by ``split`` and a manifest with the rows of each split and a hash over all of them."""
    line = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != "split"]), {"ignoreNullFields": "false"}), 256)
    hashes = F.sum(F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(38,0)"))  # whatever the order of rows
    counted = rows.groupBy("split").agg(F.count("*").alias("n"), hashes.cast("string").alias("checksum")).orderBy("split")
    rows.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)
    return write_results({"splits": counted, "columns": {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "split"}}, f"{path}/_manifest.json", rows.sparkSession)


def write_manifest(df: DataFrame, path: str) -> dict:
    """The one row of ``df`` as indented JSON."""
    row = [r["j"] for r in df.select(F.to_json(F.struct("*")).alias("j")).limit(2).collect()]
    if len(row) != 1:
        raise ValueError("a manifest has exactly one row")
    data = json.loads(row[0])
    put_text(df.sparkSession, json.dumps(data, indent=2, ensure_ascii=False) + "\n", path)
    return data


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A report table; for results of a few rows."""
    show = lambda v: "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(show(v) for v in row) + " |" for row in df.toLocalIterator()]
    return "\n".join(lines) + "\n"
