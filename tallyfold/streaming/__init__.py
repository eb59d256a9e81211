"""Streaming variants; each equals its batch query once all input has been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; the source's own log skips files already seen."""
    return spark.readStream.schema(schema).parquet(path)


def stage_timings(events: DataFrame) -> DataFrame:
    """Runs, successes, mean and longest duration by stage, in complete mode."""
    ok = (F.col("event_type") != "error").cast("long")
    return events.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("runs"), F.sum(ok).alias("ok"), F.avg("value").alias("mean_sec"), F.max("value").alias("max_sec"))


def ingest_once(files: DataFrame, late: str = "7 days") -> DataFrame:
    """The first file of each content; state of content older than `late` is dropped."""
    return files.withWatermark("mtime", late).dropDuplicatesWithinWatermark(["sha256"])
