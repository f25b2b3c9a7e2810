"""Session helpers: shared scratch tables and size estimates.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, the only
place that the driver and every executor are known to share. Where that setting
is missing (tests, notebooks) a temporary folder is used, in local mode only.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def get_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own_dir[app]


def import_path(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it again; cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_corvane_path", None)
    if path is None:
        return
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done.

    Its cleaner acts on plans that the driver's garbage collector has found
    unused, which a driver with little to do may not run for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def plan_bytes(df: DataFrame, unknown: int = 1 << 28) -> int:
    """Catalyst's size estimate of the rows of ``df``; ``unknown`` where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else unknown


def spread(df: DataFrame, least: int = 16 << 20) -> DataFrame:
    """``df``, dealt over all cores if it is small: less than ``least`` bytes a core.

    A small file may be a single row group and so a single task, whatever it takes to
    work on; large inputs have tasks enough and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < least * cores else df
