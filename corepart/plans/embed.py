"""Per-part training and the whole embedding job.

All parts train in the same Spark jobs: `part` is a key column of every table. State is
written once per epoch, so an interrupted run continues after its last finished epoch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corepart.functions import fast_normal
from corepart.operators import align, buckets, sage, walks
from corepart.operators.graph import edge_sample
from corepart.operators.skew import Hubs, find_hubs
from corepart.sources import format_embeddings
from corepart.store import Store

SYNCS = 8  # averages of the graph layers' weights per epoch, at most
SHARD_BATCHES = 4  # batches of a shard, whose vertex blocks one task holds, at least
SHARD_BYTES = 256 << 20  # of a part's vertex blocks, all of which a shard may hold


def last_epoch(store: Store, epochs: int) -> int:
    """The last epoch whose state was written to the end, or -1."""
    done = [e for e in range(epochs) if store.complete(f"epoch={e}")]
    return max(done, default=-1)


def begin_run(state: Store, pairs: DataFrame, epochs: int, **settings) -> tuple[int, dict[int, int]]:
    """The last finished epoch of the run in this folder, or -1 for a new one, which is then recorded; and the pairs of each part.

    The record holds the settings and a fingerprint of the pairs (their number and an order-free
    sum of hashes). A folder that holds another run's state is refused.
    """
    ends, bits = F.xxhash64("part", "pair", "src", "dst"), 22  # hashes are added in three pieces: as exact as decimals, and faster
    pieces = [F.sum(x).alias(f"s{i}") for i, x in enumerate((F.shiftright(ends, 2 * bits), F.shiftright(ends, bits).bitwiseAND(F.lit((1 << bits) - 1)), ends.bitwiseAND(F.lit((1 << bits) - 1))))]
    sums = pairs.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *pieces).collect()  # one row per part
    sizes, total = {r.part: r.n for r in sums}, sum((r.s0 << 2 * bits) + (r.s1 << bits) + r.s2 for r in sums) if sums else None
    own = json.dumps({**settings, "pairs": sum(sizes.values()), "fingerprint": str(total)}, sort_keys=True)
    if state.complete("run"):
        (held,) = state.read("run").collect()
        if held.run != own:
            raise ValueError(f"the state in {state.root} is of another run: {held.run}, this one is {own}")
    else:
        if any(name.startswith("epoch=") for name in state.names()):
            raise ValueError(f"the state in {state.root} does not say of which run it is")
        state.save(pairs.sparkSession.createDataFrame([(own,)], "run string"), "run")
    return last_epoch(state, epochs), sizes


# --- skip-gram with distributed vectors ---------------------------------------------


def skip_gram(
    pairs: DataFrame,
    edges: DataFrame,
    dim: int = 128,
    lr: float = 0.01,
    epochs: int = 1,
    batch_size: int = 2000,
    negatives: int = 1,
    two_tables: bool = False,
    init_scale: float = 1.0,
    seed: int = 0,
    state_path: str | None = None,
    uniform: bool = False,
    start: Column | None = None,
    bucket_bytes: int = buckets.BUCKET_BYTES,
    slot: int = buckets.SLOT,
) -> DataFrame:
    """(part, id, vec): vectors whose dot products tell true pairs from random ones.

    `pairs(part, pair, src, dst)`, `pair` unique per part; negatives are drawn from `edges`.
    The vectors are a table keyed by (part, role, id), never on the driver. An epoch is one pass over
    the examples in steps of `batch_size` pairs with their negatives, however many there are, by rotating bucket pairs
    (`operators.buckets`): a part whose vectors fit one bucket takes them one after the other,
    larger parts train disjoint pairs of buckets at the same time. With `two_tables` targets have
    vectors of their own (role 1). Negatives are drawn by in-degree, or with `uniform` from all
    vertices of the part. `start` is an array column over (part, role, id) to begin with instead
    of normal numbers.
    """
    spark = pairs.sparkSession
    work = Store(spark, "skip-gram")
    state = Store(spark, "skip-gram-state", state_path)
    target = 1 if two_tables else 0
    first, sizes = begin_run(state, pairs, epochs, seed=seed, dim=dim, batch_size=batch_size, negatives=negatives, method="skip-gram")
    if first >= 0:
        table = state.read(f"epoch={first}")
    else:
        ids = walks.part_vertices(edges.select("part", "src", "dst").unionByName(pairs.select("part", "src", "dst")))
        ids = ids.select("part", F.explode(F.array(*map(F.lit, range(target + 1)))).alias("role"), "id")
        zero = F.array_repeat(F.lit(0.0), dim)
        if start is None:
            start = fast_normal("part", "role", "id", salt=f"{seed}:start", dim=dim, scale=init_scale)
        blank = (zero.alias("m"), zero.alias("v"), F.lit(0).cast("bigint").alias("t"))
        table = work.save(ids.select(F.col("part").cast("int"), "role", "id", start.alias("vec"), *blank), "table")
    counts = buckets.bucket_counts(table, dim, bucket_bytes, sizes, slot)
    rounds = max(counts.values(), default=0)
    per_pair = 1 + negatives
    line = walks.negative_line(edges, ("part",), uniform) if counts and first + 1 < epochs else None
    for epoch in range(first + 1, epochs if counts else 0):
        part, place = F.col("part").cast("int").alias("part"), F.xxhash64("part", "pair", F.lit(f"{seed}:{epoch}")).alias("ord")
        placed = pairs.select("*", place)
        neg = walks.negative_pairs(placed, line, negatives, seed + epoch, key=("pair",), by=("part",), keep=("part", "ord", "src"))
        rows = placed.select(part, "ord", "src", "dst", F.lit(1.0).alias("y")).unionByName(
            neg.select(part, "ord", "src", F.col("neg_dst").alias("dst"), F.lit(0.0).alias("y"))
        )
        examples, slots = buckets.deal_examples(rows, counts, work, f"rows-{epoch}", slot * per_pair, {p: n * per_pair for p, n in sizes.items()})
        for r in range(rounds):
            nxt = buckets.train_round(table, examples, slots, counts, r, dim, lr, batch_size * per_pair, per_pair, target)
            last = r == rounds - 1
            table = state.save(nxt, f"epoch={epoch}") if last else work.save(nxt, f"table-{epoch}-{r}")
            if r > 0:
                work.drop(f"table-{epoch}-{r - 1}")
        work.keep_only()
    return table.where("role = 0").select("part", "id", "vec")


# --- graph layers -------------------------------------------------------------------


def train_sage(
    pairs: DataFrame,
    edges: DataFrame,
    feats: DataFrame,
    hidden: int = 128,
    fanouts: tuple[int, int] = (5, 10),
    dropout: float = 0.5,
    lr: float = 0.01,
    epochs: int = 1,
    batch_size: int = 2000,
    syncs: int = SYNCS,
    shard_batches: int = SHARD_BATCHES,
    seed: int = 0,
    state_path: str | None = None,
    hubs: Hubs | None = None,
    start: np.ndarray | None = None,
) -> tuple[dict[int, list], list[dict]]:
    """Weights of both layers per part, and one loss record per part and average.

    Neighbours are sampled from `edges`, once per epoch; `pairs(part, pair, src, dst)` are the
    positives. An epoch takes every pair once, in steps of at most `batch_size`. A part's pairs are
    dealt to at most `syncs` rounds (one per batch in small parts); in a round, shards of about `shard_batches`
    batches take their steps on their own and the part goes on with the mean of their weights and
    moments by pairs. A shard has no fewer pairs than its part has vertices, if their blocks take at most
    SHARD_BYTES: then the blocks that are shipped grow with the pairs, not with pairs times vertices.
    The driver gets one set of weights per part and round.
    """
    spark = pairs.sparkSession
    work = Store(spark, "sage")
    state = Store(spark, "sage-state", state_path)
    hubs = find_hubs(edges) if hubs is None else hubs
    sizes = {r.part: r.n for r in pairs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per part
    parts = sorted(sizes)
    head = feats.select(F.size("feat").alias("d")).first()
    if not parts or head is None:
        return {}, []
    d = head.d
    zero = sage.init_params(d, hidden, seed) if start is None else start
    states = {p: np.stack([zero, np.zeros_like(zero), np.zeros_like(zero)]) for p in parts}
    step, history = dict.fromkeys(parts, 0), []
    settings = {"seed": seed, "dim": hidden, "batch_size": batch_size, "fanouts": list(fanouts), "dropout": dropout, "method": "sage"}
    first, _ = begin_run(state, pairs, epochs, **settings)
    if first >= 0:
        for r in state.read(f"epoch={first}").collect():  # one row of weights per part
            states[r.part], step[r.part] = np.array(r.state).reshape(3, -1), r.step
    batches = {p: -(-n // batch_size) for p, n in sizes.items()}
    rounds = {p: min(syncs, b) for p, b in batches.items()}
    held = {r.part: r.n for r in feats.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per part
    own = {p: -(-held.get(p, 0) // batch_size) if held.get(p, 0) * 2 * d * 4 <= SHARD_BYTES else 0 for p in parts}
    shards = {p: -(-batches[p] // (rounds[p] * max(shard_batches, own[p]))) for p in parts}

    def dealt(table: dict[int, int], salt: str) -> Column:
        return F.pmod(F.xxhash64("part", "pair", F.lit(salt)), buckets.buckets_of(table).cast("bigint")).cast("int")

    line = walks.negative_line(edges, ("part",)) if first + 1 < epochs else None
    for epoch in range(first + 1, epochs):
        owns, near = sage.sampled_blocks(feats, edges, fanouts, seed, epoch, hubs)
        owns, near = work.save(owns, f"owns-{epoch}"), work.save(near, f"near-{epoch}")
        placed = pairs.select(
            "*", dealt(rounds, f"{seed}:{epoch}:round").alias("round"), dealt(shards, f"{seed}:{epoch}:shard").alias("shard"),
            F.xxhash64("part", "pair", F.lit(f"{seed}:{epoch}")).alias("ord"),
        )
        rows = walks.negative_pairs(placed, line, 1, seed + epoch, key=("pair",), by=("part",), keep=("part", "round", "shard", "ord", "src", "dst"))
        rows = rows.select(F.col("part").cast("int"), "round", "shard", "ord", "src", "dst", F.col("neg_dst").alias("neg"))
        rows = work.save(rows.repartition("round", F.pmod("ord", F.lit(buckets.SPREAD))).sortWithinPartitions("round"), f"rows-{epoch}")
        for r in range(max(rounds.values())):
            set_ = sage.Training(d, hidden, fanouts[1], dropout, lr, batch_size, (seed, epoch, r))
            shared = spark.sparkContext.broadcast(states)  # one set of weights per part
            ready = sage.shard_rows(rows.where(F.col("round") == r).drop("round"), owns, near, shards)
            for p, (mean, steps, loss, n) in sage.averaged(sage.train_shards(ready, shared, dict(step), set_)).items():
                states[p], step[p] = mean, steps
                history.append({"epoch": epoch, "batch": r, "part": p, "loss": loss / (2 * n)})
            shared.unpersist()
        rows_out = [(p, step[p], states[p].ravel().tolist()) for p in parts]
        state.save(spark.createDataFrame(rows_out, "part int, step int, state array<double>"), f"epoch={epoch}")
        work.keep_only()
    return {p: sage.unpack(states[p][0], d, hidden) for p in parts}, history


# --- methods ------------------------------------------------------------------------


def _edge_pairs(edges: DataFrame) -> DataFrame:
    return edges.select("part", F.concat_ws(":", "src", "dst").alias("pair"), "src", "dst")


def edge_sentences(part_edges: DataFrame, seed: int, fraction: float = 0.5) -> DataFrame:
    """(part, pair, src, dst): both directions of a random part of the edge lines.

    A line that comes twice is drawn twice. A two-word sentence trains each word on the other.
    """
    rows = walks.part_edge_lines(part_edges).groupBy("part", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("part", "src", "dst", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("line"))
    kept = edge_sample(rows, fraction, seed, key=("part", "src", "dst", "line"))
    ends = F.array(
        F.struct(F.col("src"), F.col("dst"), F.lit(0).alias("way")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("way")),
    )
    both = kept.select("part", "line", F.inline(ends))
    return both.select("part", F.concat_ws(":", "src", "dst", "line", "way").alias("pair"), "src", "dst")


def walk_training_pairs(edges: DataFrame, length: int, context: int, per_node: int, seed: int, p=1.0, q=1.0) -> DataFrame:
    """(part, pair, src, dst) from random walks."""
    w = walks.random_walks(edges, length, per_node, seed, p, q, by=("part",))
    pairs = walks.walk_pairs(w, context, by=("part",))
    return pairs.select("part", F.concat_ws(":", "origin", "walk", "j", "i").alias("pair"), "src", "dst")


def embed_parts(
    part_edges: DataFrame,
    method: str | Callable[[DataFrame], DataFrame] = "walks",
    feats: DataFrame | None = None,
    walk_length: int = 4,
    context: int = 2,
    walks_per_node: int = 2,
    p: float = 1.0,
    q: float = 1.0,
    dim: int = 128,
    seed: int = 0,
    state_path: str | None = None,
    history: list | None = None,
    **options,
) -> DataFrame:
    """(part, id, vec): every part trained on its own edges only, all parts in parallel.

    Methods: "walks" (skip-gram on random walks), "edges" (skip-gram on a sample of half of
    the edges), "sage" (graph layers on edges), "sage_walks" (graph layers, walk pairs as
    positives), or a function from part edges to (part, id, vec).
    """
    if callable(method):
        return method(part_edges)
    work = Store(part_edges.sparkSession, "embed")
    edges = work.save(walks.part_edges_clean(part_edges), "edges")
    if method == "walks":
        pairs = work.save(walk_training_pairs(edges, walk_length, context, walks_per_node, seed, p, q), "pairs")
        options = {"uniform": True, **options}
        return skip_gram(pairs, edges, dim=dim, seed=seed, state_path=state_path, **options)
    if method == "edges":
        pairs = work.save(edge_sentences(part_edges, seed), "pairs")
        options = {"negatives": 5, "two_tables": True, "init_scale": 1.0 / dim, **options}
        return skip_gram(
            pairs, pairs.select("part", "src", "dst"), dim=dim, seed=seed, state_path=state_path, **options
        )
    if method not in ("sage", "sage_walks"):
        raise ValueError(f"unknown method {method!r}")
    if feats is None:
        raise ValueError("graph layers need features")
    v = walks.part_vertices(edges)
    part_feats = work.save(walks.part_graph_feats(v, feats), "feats")
    pairs = (
        _edge_pairs(edges)
        if method == "sage"
        else work.save(walk_training_pairs(edges, walk_length, context, walks_per_node, seed, p, q), "pairs")
    )
    hubs = find_hubs(edges)
    layers, losses = train_sage(
        pairs, edges, part_feats, hidden=dim, seed=seed, state_path=state_path, hubs=hubs, **options
    )
    if history is not None:
        history.extend(losses)
    stacked = [{p: ls[i] for p, ls in layers.items()} for i in range(2)]
    h = sage.sage_infer(part_feats, edges, stacked, ("part",), hubs)
    return h.select("part", "id", F.col("feat").alias("vec"))


def embed_job(
    part_edges: DataFrame,
    parts: int,
    method: str | Callable[[DataFrame], DataFrame] = "walks",
    out_path: str | None = None,
    ridge: float = 0.0,
    dedupe: bool = False,
    **options,
) -> tuple[DataFrame, float]:
    """Train all parts, align them on the core, write `id v1 … vd` lines; returns the merged
    table and the elapsed seconds."""
    start = time.time()
    store = Store(part_edges.sparkSession, "embed-job")
    part_emb = store.save(embed_parts(part_edges, method, **options), "part-embeddings")
    merged = store.save(align.merge_embeddings(part_emb, parts, ridge, dedupe), "merged")
    if out_path:
        format_embeddings(merged).write.text(out_path)
    return merged, time.time() - start
