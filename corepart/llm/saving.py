"""Written tables for steps whose shuffles are large."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corepart.store import Store

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these settings until the end of the block; actions inside are planned with them."""
    conf = spark.conf
    before = {key: conf.get(key, None) for key in values}
    for key, value in values.items():
        conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def save_lean(store: Store, df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Write with zstd and read back.

    The write's shuffle files go at its end instead of when the driver next collects garbage.
    `batch_rows` bounds the rows of an Arrow batch, for tables whose rows are large.
    """
    with settings(df.sparkSession, {CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})):
        df.write.mode("overwrite").option("compression", "zstd").parquet(store.path(tag))
    return store.read(tag, df.schema)
