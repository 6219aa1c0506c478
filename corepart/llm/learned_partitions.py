"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph is cut into balanced parts, so that near vectors lie together. A small
softmax classifier learns, for each sample vector, in which parts its neighbours are. It then
deals every vector to its most probable part, and routes a query to its most probable parts, as
many as hold a share of the probability with which the sample finds COVER of its neighbours.
There all vectors are compared with the query and the best few are reranked by the exact measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corepart.llm.registry import query, table
from corepart.llm.saving import save_lean
from corepart.store import Store

SAMPLE = 16_384  # vectors that partitions and classifier are fitted on, whatever the size of the table
NEIGHBOURS = 10  # in the graph of the sample
PARTS = 256  # at most; fewer for small tables
PER_PART = 64  # sample vectors in a part, at least
SLACK = 1.05  # times the mean size that a part may have
SWEEPS = 30
EPOCHS, BATCH, RATE = 25, 256, 0.02
SHARPNESS = 8.0  # the classifier sees unit vectors times this
COVER = 0.95  # of the sample's neighbours lie in the parts that its vectors look at
LEAST = 2  # parts that it looks at, at least
CELL = 4096  # vectors, and queries, that one task compares at once
MARGIN = 1e-9  # by which matrix products may differ from the exact measure
BEST = 5
EVERY = 50


# --- model on a bounded sample -------------------------------------------------------


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """(n, k): places of the k nearest other vectors, block by block."""
    k = min(k, len(unit) - 1)
    out = np.zeros((len(unit), max(k, 0)), np.int64)
    for lo in range(0, len(unit) if k > 0 else 0, 1024):
        near = unit[lo : lo + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -2
        out[lo : lo + len(near)] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halved(unit: np.ndarray, parts: int) -> np.ndarray:
    """A start: parts of equal size, by splitting along the direction of greatest spread."""
    label, waiting = np.zeros(len(unit), np.int64), [(np.arange(len(unit)), 0, parts)]
    while waiting:
        rows, first, n = waiting.pop()
        if n == 1:
            label[rows] = first
            continue
        own = unit[rows] - unit[rows].mean(0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        order, cut = rows[np.argsort(own @ axis, kind="stable")], len(rows) * (n // 2) // n
        waiting += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    return label


def balanced_parts(near: np.ndarray, label: np.ndarray, parts: int, slack: float = SLACK) -> np.ndarray:
    """Move vertices to where most of their neighbours are, the greatest gains first, while there is room.

    A part holds at most `slack` times the mean. In a sweep a random half may move, so that
    neighbours do not swap places.
    """
    n, draw = len(label), np.random.default_rng(1)
    label, room = label.copy(), int(np.ceil(slack * len(label) / parts))
    ends = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    others = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    for _ in range(SWEEPS):
        votes = np.bincount(ends * parts + label[others], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        movers = np.flatnonzero((gain > 0) & (draw.random(n) < 0.5))
        movers = movers[np.lexsort((-gain[movers], best[movers]))]
        rank = np.arange(len(movers)) - np.searchsorted(best[movers], best[movers])
        free = np.maximum(room - np.bincount(label, minlength=parts), 0)
        movers = movers[rank < free[best[movers]]]
        if not len(movers):
            break
        label[movers] = best[movers]
    return label


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def fit_router(unit: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights (d + 1, parts) of a softmax classifier for rows of `target`, by Adam."""
    x = np.concatenate([unit * SHARPNESS, np.ones((len(unit), 1))], 1)
    w, m, v = (np.zeros((x.shape[1], target.shape[1])) for _ in range(3))
    draw, step = np.random.default_rng(2), 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            rows = order[lo : lo + BATCH]
            slope = x[rows].T @ (softmax(x[rows] @ w) - target[rows]) / len(rows)
            step += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def learn_parts(vectors: np.ndarray, parts: int, cover: float = COVER) -> tuple[np.ndarray, float]:
    """The router fitted on a sample: neighbour graph, balanced parts, classifier of the neighbours' parts.

    With it the mass: looking at the most probable parts until they hold this much finds `cover` of
    the sample's neighbours. The neighbours of a sample are farther than those of the whole
    table, so there it finds rather more.
    """
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    near = neighbour_graph(unit, NEIGHBOURS)
    label = balanced_parts(near, halved(unit, parts), parts)
    around = np.concatenate([label[:, None], label[near]], 1)
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.arange(len(unit))[:, None], around), 1 / around.shape[1])
    router = fit_router(unit, target)
    odds = part_odds(vectors, router)
    order = np.argsort(-odds, axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each part in a vector's order
    before = np.cumsum(np.take_along_axis(odds, order, 1), 1) - np.take_along_axis(odds, order, 1)
    needed = np.take_along_axis(before, np.take_along_axis(place, odds.argmax(1)[near], 1), 1)
    return router, float(np.quantile(needed, cover)) + 1e-12 if needed.size else 1.0


def part_odds(vectors: np.ndarray, router: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return softmax(unit @ (router[:-1] * SHARPNESS) + router[-1])


# --- index and search ----------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, vec): rows with an id whose vector is neither null, empty nor zero and has finite numbers only."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # false for NaN, which is greatest
    return rows.where(F.col("vec_id").isNotNull() & good & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit_sample(vectors: DataFrame, parts: int, sample: int, cover: float) -> tuple[np.ndarray, float]:
    """Router and mass, fitted in one task on at most `sample` vectors chosen by a hash of the id."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches)
        router, mass = learn_parts(np.stack(rows["vec"].to_numpy()).astype(float), parts, cover)
        yield pd.DataFrame({"n": [router.shape[1]], "router": [router.ravel()], "mass": [mass]})

    found = chosen.repartition(1).mapInPandas(fit, "n int, router array<double>, mass double").first()
    return np.array(found.router).reshape(-1, found.n), found.mass


def placed(vectors: DataFrame, router: np.ndarray) -> DataFrame:
    """(vec_id, vec, part): every vector in its most probable part."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                odds = part_odds(_matrix(batch.column("vec")), router)
                yield batch.append_column("part", pa.array(odds.argmax(1).astype(np.int32)))

    return vectors.mapInArrow(place, T.StructType([*vectors.schema.fields, T.StructField("part", T.IntegerType())]))


def routed(queries: DataFrame, router: np.ndarray, mass: float, least: int) -> DataFrame:
    """(vec_id, vec, part): a query once for each of the parts that it looks at, the most probable ones."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            odds = part_odds(_matrix(batch.column("vec")), router)
            order = np.argsort(-odds, axis=1, kind="stable")
            sums = np.cumsum(np.take_along_axis(odds, order, 1), 1)
            looks = np.maximum((sums < mass).sum(1) + 1, least)
            at, rank = np.nonzero(np.arange(odds.shape[1]) < looks[:, None])
            yield batch.take(pa.array(at)).append_column("part", pa.array(order[at, rank].astype(np.int32)))

    return queries.mapInArrow(route, T.StructType([*queries.schema.fields, T.StructField("part", T.IntegerType())]))


def in_cells(rows: DataFrame, sizes: dict[int, int], name: str) -> DataFrame:
    """Deal a part's rows to cells of about CELL rows by a hash of the id."""
    cells = F.create_map(*(F.lit(x) for p, n in sizes.items() for x in (p, -(-n // CELL)))) if sizes else F.create_map().cast("map<int,int>")
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.coalesce(cells[F.col("part")], F.lit(1)).cast("bigint")).cast("int"))


def part_sizes(rows: DataFrame) -> dict[int, int]:
    return {r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per part


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows; the same for equal vectors wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest_in_cell(best: int):
    """For each query of a cell: its `best` nearest vectors there, by the exact measure, ties to the smaller id."""

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(queries.column("vec")), _matrix(rows.column("vec"))
        q_ids, ids = (t.column("vec_id").to_numpy() for t in (queries, rows))
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        found = []
        for lo in range(0, len(q), 256):
            own = q[lo : lo + 256]
            near = (own / np.sqrt((own * own).sum(1, keepdims=True))) @ unit.T
            near[q_ids[lo : lo + 256, None] == ids[None, :]] = -2
            k = min(best, near.shape[1])
            limit = -np.partition(-near, k - 1, axis=1)[:, k - 1]
            at, to = np.nonzero((near >= limit[:, None] - MARGIN) & (near > -1.5))
            score = cosines(own[at], x[to])
            order = np.lexsort((ids[to], -score, at))
            at, to, score = at[order], to[order], score[order]
            first = np.searchsorted(at, at)
            keep = np.arange(len(at)) - first < best
            found.append((q_ids[lo : lo + 256][at[keep]], ids[to[keep]], score[keep]))
        return pa.table({name: np.concatenate(c) for name, c in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    return compare


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    best: int = BEST,
    parts: int | None = None,
    sample: int = SAMPLE,
    cover: float = COVER,
    least: int = LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `best` nearest vectors found, nearest first.

    `vectors` and `queries` are (vec_id, embedding); a query is not its own neighbour, that is, no row with its
    vec_id is. score is the cosine in double precision; equal ones are ordered by vec_id. Rows
    without an id, and vectors that are null, empty, zero or not finite, take no part. A repeated row
    can be found twice; a query's id that comes more than once asks with its least vector. All
    vectors must have the same length. Few vectors give fewer neighbours, none give no rows.
    """
    store = Store(vectors.sparkSession, "learned-partitions")
    good = save_lean(store, usable(vectors), "vectors")
    n = good.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if parts is None:  # parts grow with the root of the table, so that scans do too
        parts = int(round(n**0.5 / 4))
    parts = max(1, min(parts, PARTS, min(sample, n) // PER_PART))
    router, mass = fit_sample(good, parts, sample, cover)
    index = save_lean(store, placed(good, router), "index")
    asked = usable(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asks = save_lean(store, routed(asked, router, mass, least), "asks")
    store.drop("vectors")
    sizes, ask_sizes = part_sizes(index), part_sizes(asks)
    # Every cell of a part's queries meets every cell of its vectors: both are copied once per cell of the other.
    def all_cells(sizes: dict[int, int]):
        counts = F.create_map(*(F.lit(x) for p, k in sizes.items() for x in (p, -(-k // CELL))))
        return F.explode(F.sequence(F.lit(0), F.coalesce(counts[F.col("part")], F.lit(1)) - 1))

    key = ["part", "cell", "ask"]
    dealt = in_cells(index, sizes, "cell").withColumn("ask", all_cells(ask_sizes or {-1: 1}))
    dealt_asks = in_cells(asks, ask_sizes, "ask").withColumn("cell", all_cells(sizes))
    compare = nearest_in_cell(best)
    near = dealt_asks.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    near = save_lean(store, near, "near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    out = save_lean(store, out.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "found")
    store.keep_only("found")
    return out


@query("op12_learned_partitions")
def op12_learned_partitions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
