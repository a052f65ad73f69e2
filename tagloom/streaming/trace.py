"""Training traces as streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = ("run_id long, ts timestamp, type string, step int, maxSteps int, epoch int, secondsPerStep double, phase string, "
                "message string, _corrupt_record string")


def read_trace(spark: SparkSession, folder: str) -> DataFrame:
    """NDJSON trace files as they arrive; broken or unfinished lines are dropped."""
    raw = spark.readStream.schema(TRACE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less timestamps as event time in UTC, which watermarks require."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed(events: DataFrame, late: str, window, keys: list[str]) -> DataFrame:
    """Events and value per window and key, state bounded by the watermark."""
    return events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def drop_duplicates(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Suppress repeated arrivals; keys older than the watermark leave the state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
