"""Global positions and running totals without a single-task window.

Rows are range-partitioned and sorted; each partition numbers its own rows, and one
small row per partition carries the offsets. No partition sees more than its range.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corepart.store import Store

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _add_offsets(stored: DataFrame, local: str, size, out: str) -> DataFrame:
    """Add to `local` the sum of `size` over all earlier partitions (`_pid`)."""
    sizes = stored.groupBy("_pid").agg(size.alias("n")).collect()  # one row per partition
    offset, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r._pid):
        offsets.append((r._pid, offset))
        offset += r.n
    table = stored.sparkSession.createDataFrame(offsets, "_pid int, _off bigint")
    return (
        stored.join(F.broadcast(table), "_pid")
        .withColumn(out, F.col(local) + F.col("_off"))
        .drop("_pid", "_off", local)
    )


def dense_index(df: DataFrame, order: list[str], out: str = "pos", store: Store | None = None) -> DataFrame:
    """Add `out` = 0-based position in the global order of `order` (which must be unique).

    The sorted rows are a table that the result is read from: in the caller's `store`, to be dropped with it,
    or in one of its own.
    """
    store = Store(df.sparkSession, "dense-index") if store is None else Store(df.sparkSession, "", store.path(f"index-{uuid.uuid4().hex}"))
    mid = F.monotonically_increasing_id()
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", mid)
        .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS).cast("int"))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_mid")
    )
    stored = store.save(numbered, "rows")
    return _add_offsets(stored, "_local", F.max("_local") + 1, out)


def running_total(df: DataFrame, order: list[str], value: str, out: str = "upto") -> DataFrame:
    """Add `out` = sum of the BIGINT column `value` over all rows up to and including this one.

    Values may be negative; a null counts as 0.
    """
    store = Store(df.sparkSession, "running-total")

    def accumulate(batches):
        done = 0
        for batch in batches:
            local = done + np.cumsum(np.asarray(batch.column("_value")))
            if len(local):
                done = int(local[-1])
            yield batch.append_column("_local", pa.array(local, pa.int64()))

    sorted_rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_pid": F.spark_partition_id(), "_value": F.coalesce(F.col(value).cast("bigint"), F.lit(0))})
    )
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_local", T.LongType())])
    stored = store.save(sorted_rows.mapInArrow(accumulate, schema), "rows")
    return _add_offsets(stored, "_local", F.sum("_value"), out).drop("_value")


__all__ = ["dense_index", "running_total"]
