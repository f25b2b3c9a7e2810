"""Continuous intake with Structured Streaming: append once, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def append_once(stream: DataFrame, key: str, target: str, checkpoint: str, batch_time: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Append rows whose key has not been seen; all that is there, then stop.

    With ``batch_time`` keys are remembered within the watermark only, so the
    state stays bounded; without it every key is remembered.
    """
    seen = stream.withWatermark(batch_time, delay).dropDuplicatesWithinWatermark([key]) if batch_time else stream.dropDuplicates([key])
    return seen.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, window: str, delay: str, *keys: str) -> DataFrame:
    """Rows and sum of ``value`` by time window and keys, late rows up to ``delay``."""
    w = F.window(time, window)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a time zone's timestamps
    return stream.withWatermark(time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def run_available(counts: DataFrame, spark: SparkSession, time: str | None = None) -> DataFrame:
    """Run a windowed stream over all that is there and return what it has emitted.

    Windows that the watermark has not passed at the end of the input are not
    emitted in append mode. With ``time`` (the name of the time column) the stream
    runs in update mode instead and the last state of each window counts, so the
    input is taken for complete and every window is there.
    """
    target, mark = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    writer = counts.writeStream.option("checkpointLocation", mark).trigger(availableNow=True)
    if time is None:
        writer.format("parquet").outputMode("append").option("path", target).start().awaitTermination()
        return spark.read.schema(counts.schema).parquet(target)

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    writer.outputMode("update").foreachBatch(store).start().awaitTermination()
    keys = [c for c in counts.columns if c not in ("n", "total")]
    schema = counts.schema.add("batch", "long")
    states = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)
    last = F.max_by(F.struct("n", "total"), "batch").alias("last")
    return states.groupBy(*keys).agg(last).select(*keys, "last.n", "last.total")
