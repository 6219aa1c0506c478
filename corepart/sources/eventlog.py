"""Bytes moved by a Spark job, from its event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The event and metric names that Spark writes.
STAGE_COMPLETED = '"Event":"SparkListenerStageCompleted"'
REMOTE_READ = r'"internal\.metrics\.shuffle\.read\.remoteBytesRead","Value":([0-9]+)'
RESULT_SIZE = r'"internal\.metrics\.resultSize","Value":([0-9]+)'


def read_stage_events(spark: SparkSession, path: str) -> DataFrame:
    """(value): the stage-completed lines of an event log."""
    return stage_events(spark.read.text(path))


def stage_events(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").contains(STAGE_COMPLETED))


def stage_bytes(lines: DataFrame) -> DataFrame:
    """(remote_bytes_read, result_size) per completed stage; null where a metric is absent."""

    def metric(pattern: str):
        return F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast("bigint")

    return stage_events(lines).select(
        metric(REMOTE_READ).alias("remote_bytes_read"), metric(RESULT_SIZE).alias("result_size")
    )


def shuffle_bytes(lines: DataFrame) -> DataFrame:
    """One row (remote_bytes_read, result_size, total_gb)."""
    sums = stage_bytes(lines).agg(
        F.coalesce(F.sum("remote_bytes_read"), F.lit(0)).alias("remote_bytes_read"),
        F.coalesce(F.sum("result_size"), F.lit(0)).alias("result_size"),
    )
    total = (F.col("remote_bytes_read") + F.col("result_size")) / F.lit(1e9)
    return sums.withColumn("total_gb", total)
