"""Session settings that suit the jobs of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Two or three tasks per core keep cores busy; adaptive execution merges small ones and
# splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def builder(name: str, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """A session builder with these settings; master and memory are left to the caller.

    On a cluster, set spark.checkpoint.dir to a shared folder and `shuffle_partitions` so that
    one partition of the edges takes about 128 to 256 MB.
    """
    out = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else out
