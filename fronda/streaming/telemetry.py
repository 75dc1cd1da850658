"""Telemetry as a stream: JSON lines in, windowed roll-ups out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """timestamp timestamp, trace_id string, session_id string, event string, tool string, action string, duration_ms double, cache_hit boolean, empty_result boolean,
    status string, metrics struct<bytes_out:long,lines_out:long,items_found:long,source_bytes:long>, error struct<code:string,message:string>"""


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Batch read; lines that are not JSON objects are left out."""
    rows = spark.read.schema(SCHEMA + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(folder)
    return rows.filter("_broken IS NULL").drop("_broken")


def read_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def rollup(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls, errors, slow calls and durations a window and tool; later events than the watermark are dropped."""
    return (
        events.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", window).alias("w"), "tool")
        .agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("duration_ms") >= 250).alias("slow"), F.avg("duration_ms").alias("avg_ms"), F.sum("metrics.items_found").alias("items"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "calls", "errors", "slow", "avg_ms", "items")
    )


def run(events: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Write roll-ups as Parquet until the input that is there has been read."""
    query = rollup(events).writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
