"""Mixing sources to target weights by Poisson replication.

Every document is repeated Poisson(rate) times, where its source's rate is the target share
of that source over its present share. The count is drawn by inversion: a uniform number
hashed from the document and a seed is looked up in the distribution. Copies are then
shuffled globally by a hashed key. Draws depend on keys only, so a task that runs again
after a lost executor repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.functions.draw import draw
from corepart.llm.registry import query, table

BROADCAST_SOURCES = 10_000  # rate rows that may be broadcast, 0.6 kB each
STEP = 8.0  # a larger mean is drawn as a sum of draws with at most this mean
TERMS = 64  # terms of the distribution: beyond 63 its mass is under 1e-30 at a mean of 8


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size): characters of every source over all documents; a null text has none."""
    size = F.coalesce(F.sum(F.length(text)), F.lit(0))
    return docs.groupBy(F.col(source).alias("source")).agg(size.cast("bigint").alias("size"))


def tempered_weights(sizes: DataFrame, power: float = 0.5) -> DataFrame:
    """(source, weight): the size to a power below 1, which lifts small sources."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean copies of a document so that sources meet their weights.

    All copies together have `epochs` times the size of the input. A source without a weight,
    or with one that is null or not positive, has rate 0; so has one without any text. A null
    source is a source of its own.
    """
    usable = F.when((F.col("weight") > 0) & (F.col("size") > 0), F.col("weight")).otherwise(0.0)
    known = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").alias("weight"))
    joined = sizes.join(known, F.col("source").eqNullSafe(F.col("w_source")), "left").withColumn("weight", usable)
    sums = joined.agg(F.sum("weight").alias("weight"), F.sum("size").alias("size")).first()
    rate = F.lit(epochs) * F.lit(sums["size"]) * F.col("weight") / F.lit(sums["weight"]) / F.col("size")
    return joined.select("source", F.when(F.col("weight") > 0, rate).otherwise(0.0).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Array of P(count <= k) for k = 0, 1, ..."""
    start = F.exp(-mean)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(start.alias("term"), start.alias("sum"), F.array(start).alias("cdf")),
        lambda s, k: F.struct(
            (s["term"] * mean / k).alias("term"),
            (s["sum"] + s["term"] * mean / k).alias("sum"),
            F.concat(s["cdf"], F.array(s["sum"] + s["term"] * mean / k)).alias("cdf"),
        ),
    )
    return terms["cdf"]


def _key(doc_id: Column, text: Column) -> Column:
    """What a document's draws hang on: its id, else its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256)))


def replicate(
    docs: DataFrame,
    rates: DataFrame,
    seed: int = 0,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(row, copy_no, shuffle_key): each document as often as drawn, in random order.

    `row` holds the whole document. A source that `rates` does not name is left out. Repeated
    rows have the same draws. The order is by `shuffle_key` within each partition, and the
    partition is a hash of it.
    """
    drawn = (
        rates.withColumn("steps", F.ceil(F.col("rate") / STEP).cast("int"))
        .where(F.col("steps") > 0)
        .select(F.col("source").alias("r_source"), "steps", _distribution(F.col("rate") / F.col("steps")).alias("cdf"))
    )
    if rates.count() <= BROADCAST_SOURCES:
        drawn = F.broadcast(drawn)
    salt = f"{seed}:count"
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("steps")),
        F.lit(0),
        lambda total, i: total
        + F.size(F.filter("cdf", lambda p: p < draw("key", i.cast("string"), salt=salt))),
    )
    return (
        docs.select(
            F.struct("*").alias("row"),
            F.col(source).alias("source"),
            _key(F.col(doc_id), F.col(text)).alias("key"),
        )
        .join(drawn, F.col("source").eqNullSafe(F.col("r_source")))
        .select("row", "key", count.alias("n"))
        .where(F.col("n") > 0)
        .select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
        .select("row", "copy_no", F.md5(F.concat_ws(":", "key", "copy_no", F.lit(f"{seed}:order"))).alias("shuffle_key"))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """Replicate documents to the target weights; without weights, to tempered ones."""
    sizes = source_sizes(docs)
    rates = repetition_rates(sizes, tempered_weights(sizes) if weights is None else weights, epochs)
    return replicate(docs, rates, seed)


def spread(mixed: DataFrame) -> DataFrame:
    """The documents' own columns, then copy_no and shuffle_key.

    Where a document has a column of that name already, in any case, the added one gets a
    number: copy_no_2, copy_no_3, ...
    """
    taken = {f.name.lower() for f in mixed.schema["row"].dataType.fields}

    def free(name: str) -> str:
        names = [name, *(f"{name}_{k}" for k in range(2, len(taken) + 3))]
        return next(n for n in names if n not in taken)

    return mixed.select("row.*", *(F.col(c).alias(free(c)) for c in ("copy_no", "shuffle_key")))


SQL = """
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM {docs} GROUP BY source),
w AS (SELECT source, size, CASE WHEN size > 0 THEN sqrt(size::DOUBLE) ELSE 0.0 END AS weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN weight > 0 THEN (SELECT sum(size) FROM w)::DOUBLE * weight
    / (SELECT sum(weight) FROM w) / size ELSE 0.0 END AS rate FROM w),
steps AS (SELECT source, rate, ceil(rate / 8.0)::INTEGER AS steps FROM rates WHERE rate > 0),
cdf AS (
  SELECT source, k, sum(exp(-rate / steps + k * ln(rate / steps) - lgamma(k + 1.0)))
    OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS p
  FROM steps, range(0, 64) t(k)),
draws AS (
  SELECT d.doc_id, d.source, i,
    ('0x' || substr(md5(d.doc_id::VARCHAR || ':' || i || ':0:count'), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM {docs} d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source, LATERAL unnest(range(1, s.steps + 1)) t(i)),
counts AS (
  SELECT doc_id, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM x.source AND c.p < x.u))::BIGINT AS n
  FROM draws x GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy_no::INTEGER AS copy_no,
  md5(d.doc_id::VARCHAR || ':' || c.copy_no || ':0:order') AS shuffle_key
FROM {docs} d JOIN (SELECT doc_id, unnest(range(1, n + 1)) AS copy_no FROM counts) c USING (doc_id)
"""


@query("op2_poisson_mix", SQL.format(docs="documents"))
def op2_poisson_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, repeated to weights that grow with the square root of a source's size."""
    return spread(mix_sources(table(spark, sf, "documents")))
