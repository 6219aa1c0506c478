"""Tables in the shared checkpoint folder, used to cut lineage between rounds.

A round of a loop ends in a parquet table, not in a cached block: it survives the
loss of any executor, it is read back with column pruning, and its file sizes give
the optimizer true statistics for the next round's joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="corepart-")
    return _LOCAL_DIRS[sc.applicationId]


class Store:
    """One job's tables: `save` writes and reads back, `drop` frees an outdated round."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        self.root = path.rstrip("/") if path else f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}  # names of bucketed tables in the catalog

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}" if tag else self.root

    def save(self, df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(tag))
        return self.read(tag, df.schema)

    def save_bucketed(self, df: DataFrame, tag: str, cols: list[str], placed: bool = False) -> DataFrame:
        """Write in buckets of `cols`, one file each, and read back as they lie.

        Joins and groups on these columns need no shuffle of the table. The buckets are as many as
        the session's shuffle partitions. They are known to the catalog of this session only, until
        `drop`. `placed` rows come from such a table and are in its buckets already.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"corepart_{uuid.uuid4().hex}"
        writer = (df if placed else df.repartition(n, *cols)).write.bucketBy(n, *cols).sortBy(*cols)
        writer.format("parquet").option("path", self.path(tag)).saveAsTable(name)
        self.tables[tag] = name
        return self.spark.table(name)

    def read(self, tag: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(tag))

    def _hadoop(self, tag: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path.getFileSystem(conf), path, jvm

    def complete(self, tag: str) -> bool:
        """True when the table was written to the end."""
        fs, path, jvm = self._hadoop(tag)
        return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))

    def names(self, tag: str = "") -> list[str]:
        """The tables (folders) directly under `tag`."""
        fs, path, _ = self._hadoop(tag)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def keep_only(self, *tags: str) -> None:
        """Drop every table but these: what a finished job leaves is its result."""
        for name in self.names():
            if name not in tags:
                self.drop(name)

    def drop(self, tag: str) -> None:
        if tag in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(tag)}")
        fs, path, _ = self._hadoop(tag)
        fs.delete(path, True)
