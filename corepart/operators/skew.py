"""Joins of per-vertex attributes onto edges, safe against hub vertices.

One vertex may be an endpoint of a third of all edges. A hash join would send all
of them to one task. The largest vertices are found once per graph; their edges are
spread over slots and only their attribute rows are copied, once per slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


RESIDENT_BYTES = 64 << 20  # of a written table in one kept partition
TASK_ROWS = 1_000_000  # that one task sorts or tells apart


@dataclass(frozen=True)
class Hubs:
    """(id, number of slots) of the hub vertices: never more than `top` of find_hubs."""

    fans: tuple[tuple[int, int], ...] = ()

    def __bool__(self) -> bool:
        return bool(self.fans)

    def table(self, df: DataFrame, key: str) -> DataFrame:
        rows = df.sparkSession.createDataFrame(list(self.fans), f"`{key}` bigint, _fan int")
        return F.broadcast(rows)


def find_hubs(df: DataFrame, *cols: str, min_rows: int = 1_000_000, top: int = 100_000) -> Hubs:
    """The at most `top` ids with more than `min_rows` rows, counted over `cols` together.

    A slot holds about `min_rows` rows. Ids outside the top hold at most 1/top of all rows each,
    so they need no slots. The broadcast made from the result has at most `top` rows (some
    megabytes), whatever the input size; all slots together add one attribute row per
    `min_rows` rows.
    """
    cols = cols or ("src", "dst")
    ids = df.select(F.explode(F.array(*cols)).alias("id"))
    return hubs_of(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "n", min_rows, top)


def hubs_of(counts: DataFrame, column: str, min_rows: int = 1_000_000, top: int = 100_000) -> Hubs:
    """The same from a table that already has the row count of every id."""
    n = F.col(column).alias("n")
    biggest = counts.select("id", n).where(F.col("n") > min_rows).orderBy(F.desc("n"), "id").limit(top)
    return Hubs(tuple((r.id, -(-r.n // min_rows)) for r in biggest.collect()))


def _with_slots(rows: DataFrame, key: str, hubs: Hubs, spread_by: tuple[str, ...]) -> DataFrame:
    slot = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_fan"), F.lit(1)).cast("bigint"))
    return rows.join(hubs.table(rows, key), key, "left").withColumn("_slot", slot.cast("int")).drop("_fan")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: one for TASK_ROWS and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(rows: DataFrame, key: str, hubs: Hubs | None, spread_by: tuple[str, ...]) -> DataFrame:
    """Rows partitioned by `key` (and slot) for a `lookup` on that key. `rows` should come from a written table: its
    files' size gives the number of partitions, one for RESIDENT_BYTES and no fewer than the session's."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    slices = max(slices, -(-written // RESIDENT_BYTES))
    on = [key]
    if hubs:
        rows, on = _with_slots(rows, key, hubs, spread_by), [key, "_slot"]
    return rows.repartition(slices, *on)


def resident(rows: DataFrame, key: str, hubs: Hubs | None, spread_by: tuple[str, ...]) -> DataFrame:
    """Keep rows partitioned by `key` (and slot) for many `lookup`s on that key.

    Rounds then shuffle only the small per-vertex side. `rows` should come from a written
    table: a block lost with its executor is read and partitioned again, as `dealt` says. Call unpersist() after.
    """
    return dealt(rows, key, hubs, spread_by).persist(StorageLevel.MEMORY_AND_DISK)


def lookup(
    rows: DataFrame,
    key: str,
    attrs: DataFrame,
    hubs: Hubs | None = None,
    spread_by: tuple[str, ...] = (),
    by: tuple[str, ...] = (),
    how: str = "inner",
    hint: str | None = None,
) -> DataFrame:
    """Join `attrs` (one row per `by` + id) onto `rows` by `by` + `key`.

    `spread_by` names columns of `rows` that vary among the rows of one hub. `hint` names a join method:
    "merge" keeps tables that are small as files, but have a row per vertex, from being sent through the driver.
    """
    told = (lambda df: df.hint(hint)) if hint else (lambda df: df)
    right = attrs if key == "id" else attrs.withColumnRenamed("id", key)
    on = [*by, key]
    if not hubs:
        return rows.join(told(right), on, how)
    left = rows if "_slot" in rows.columns else _with_slots(rows, key, hubs, spread_by)
    slots = F.sequence(F.lit(0), F.coalesce(F.col("_fan") - 1, F.lit(0)))
    right = (
        right.join(hubs.table(right, key), key, "left").withColumn("_slot", F.explode(slots)).drop("_fan")
    )
    return left.join(told(right), [*on, "_slot"], how).drop("_slot")
