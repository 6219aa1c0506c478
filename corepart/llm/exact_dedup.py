"""Exact deduplication as a stream with keyed state.

Arrivals (digest, identifier, content locator) are absorbed by a streaming aggregation whose
state lives in RocksDB on disk, with a checkpoint in the shared folder and no expiry: per
digest the number of texts and the identifier and locator of the one that stays. Later
batches continue from that state. On a hit, that is for digests seen more than once, the
texts are fetched by locator and compared byte by byte with the one that stays; texts that
differ under one digest are grouped by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.registry import query, table
from corepart.store import Store

ARRIVAL = "digest binary, doc_id bigint, file string, row bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, store: Store, from_files: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, doc_id, text, file, row): each row with the Parquet file and row number it is in.

    `from_files`: `docs` is itself a scan of Parquet files; else it is written first.
    """
    packed = F.struct("*").alias("doc")
    if not from_files or "_metadata" in docs.columns:
        docs = store.save(docs.select(packed), "rows")
        packed = F.col("doc")
        doc_id, text = f"doc.{doc_id}", f"doc.{text}"
    return docs.select(
        packed,
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


class DedupState:
    """Keyed state in a folder; `absorb` takes a batch in, `table` reads what is known."""

    def __init__(self, store: Store):
        self.store = store
        # Not the caller's session: settings of the state stay with this stream.
        self.session = store.spark.newSession()
        partitions = store.spark.conf.get("spark.sql.shuffle.partitions")
        for key, value in STATE_SETTINGS.items():
            self.session.conf.set(key, value)
        self.session.conf.set("spark.sql.shuffle.partitions", partitions)

    def write_batch(self, arrivals: DataFrame, batch: str) -> None:
        """Store the arrivals under the batch's name, once."""
        if "/" in batch or not batch or batch[0] in "._":
            raise ValueError(f"not a name for a batch: {batch!r}")
        begun = self.store.names("arrivals")
        open_ones = [b for b in begun if b != batch and not self.store.complete(f"arrivals/{b}")]
        if open_ones:
            raise ValueError(f"batch {open_ones[0]!r} was not written to its end: absorb it first")
        if batch not in begun or not self.store.complete(f"arrivals/{batch}"):
            arrivals.write.mode("overwrite").parquet(self.store.path(f"arrivals/{batch}"))

    def absorb(self, arrivals: DataFrame, batch: str) -> None:
        """Add rows (digest, doc_id, file, row) as the batch of this name.

        A batch counts once: after a failure the same call goes on where it stopped, and a batch
        that was absorbed to its end changes nothing.
        """
        self.write_batch(arrivals, batch)
        stream = self.session.readStream.schema(ARRIVAL).option("recursiveFileLookup", "true").parquet(self.store.path("arrivals"))
        counted = stream.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep")
        )
        job = (
            counted.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", self.store.path("state"))
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()

    def arrivals(self) -> DataFrame:
        return self.store.spark.read.schema(ARRIVAL).option("recursiveFileLookup", "true").parquet(self.store.path("arrivals"))

    def table(self) -> DataFrame:
        """(digest, n, keep): keep is the greatest (doc_id, file, row); a null id is the least."""
        state = self.store.spark.read.format("statestore").load(self.store.path("state"))
        n, keep = state.schema["value"].dataType.names
        return state.select("key.digest", F.col("value")[n].alias("n"), F.col("value")[keep].alias("keep"))


def dedup_groups(rows: DataFrame, store: Store, digest=sha256) -> DataFrame:
    """(doc_id, file, row, digest, n, keep): every row with its group's size and the row that stays.

    `rows` comes from `located`. Texts are equal when all bytes are; a null text is empty. The
    greatest (doc_id, file, row) stays, so of rows with the same id exactly one. `digest` may be
    any function: texts that collide are told apart.
    """
    state = DedupState(store)
    tagged = rows.select("doc_id", "text", "file", "row", digest(F.col("text")).alias("digest"))
    state.absorb(tagged.select("digest", "doc_id", "file", "row"), "all")
    known = store.save(state.table(), "known")
    single = state.arrivals().join(known.where("n = 1"), "digest")
    hits = store.save(tagged.join(known.where("n > 1").select("digest", "keep"), "digest"), "hits")
    own = F.struct("doc_id", "file", "row")
    stays = hits.where(own.eqNullSafe(F.col("keep"))).select("digest", F.col("text").alias("keep_text"))
    checked = store.save(
        hits.join(stays, "digest").select(
            "digest", "doc_id", "file", "row", F.when(F.col("text") != F.col("keep_text"), F.col("text")).alias("odd")
        ),
        "checked",
    )
    groups = checked.groupBy("digest", "odd").agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("keep"))
    copies = (
        checked.withColumnRenamed("digest", "d")
        .withColumnRenamed("odd", "o")
        .join(groups, (F.col("d") == F.col("digest")) & F.col("o").eqNullSafe(F.col("odd")))
    )
    out = ["doc_id", "file", "row", "digest", "n", "keep"]
    return single.select(*out).unionByName(copies.select(*out))


def exact_dedup(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document, dropped ones too."""
    store = Store(docs.sparkSession, "exact-dedup")
    groups = dedup_groups(located(docs, store, from_files), store)
    return groups.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    store = Store(docs.sparkSession, "exact-dedup")
    rows = located(docs, store, from_files)
    at = F.struct("doc_id", "file", "row")
    dropped = (
        dedup_groups(rows, store).where(~at.eqNullSafe(F.col("keep"))).select(F.col("file").alias("f"), F.col("row").alias("r"))
    )
    return rows.join(dropped, (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")), "left_anti").select("doc.*")


@query(
    "op10_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
)
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"), from_files=True)
