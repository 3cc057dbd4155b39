"""Incremental intake: files that arrive are read as a stream, records are taken once, aggregates match the batch ones.

All streams run with ``availableNow`` and a checkpoint, so a restart continues where the last run ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def stream_files(spark: SparkSession, folder: str, schema: StructType, fmt: str = "json", glob: str | None = None) -> DataFrame:
    """A stream of the files of a folder."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.format(fmt).load(folder)


def append_once(stream: DataFrame, key: str, at: str, late: str, out: str, checkpoint: str) -> None:
    """Append each key's first record to a Parquet folder; state for a key is kept as long as ``late`` allows."""
    q = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, by: list[str], out: str, checkpoint: str) -> None:
    """Counts and sums per time window and key; every micro-batch merges its updated windows into the table ``out``."""
    agg = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    flat = agg.select(F.col("w.start").alias("window_start"), *by, "n")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    flat.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def latest_windows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last value of each window that :func:`windowed_counts` has written."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the events table, read as a stream."""
    import uuid

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = stream_files(spark, sf_dir, schema, "parquet", "events.parquet")
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    windowed_counts(s, "ts", "1 day", "2 days", ["event_type"], f"{base}/out", f"{base}/checkpoint")
    return latest_windows(spark, f"{base}/out", ["window_start", "event_type"])
