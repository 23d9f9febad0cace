"""Streams of measurements: windows, sessions and late rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files that match a path as they come, with the schema of those there and ts as an instant."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls by window and operation; a stream drops rows that come later than the watermark, and with it the state of older windows (in append and update mode)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", size).alias("w"), F.col("event_type").alias("op")).agg(F.count("*").alias("calls"), F.max("value").alias("longest"))
    return counted.select(F.col("w.start").alias("begin"), "op", "calls", "longest")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    s = F.session_window("ts", gap)
    return rows.groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("calls")).select("user_id", F.col("s.start").alias("begin"), "calls")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints; a temporary one in local sessions that name none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{named or tempfile.mkdtemp()}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, keys: tuple[str, ...] = ("begin", "op")) -> DataFrame:
    """Runs a stream over all that is there and returns its result table, the latest row for each key.

    Each batch adds its changed rows to Parquet files in a shared folder; nothing passes through the driver.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "drained")
    spark.createDataFrame([], stream.schema).selectExpr("*", "0L AS _batch").write.parquet(f"{folder}/rows")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.selectExpr("*", f"{batch}L AS _batch").write.mode("append").parquet(f"{folder}/rows")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    latest = spark.read.parquet(f"{folder}/rows").groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return latest.select(*keys, "_row.*").select(*stream.columns)
