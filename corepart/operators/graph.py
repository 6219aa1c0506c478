"""Graph operators over `edges(src BIGINT, dst BIGINT)`; duplicates and self-loops are kept."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corepart.functions import draw
from corepart.operators.order import dense_index
from corepart.operators.skew import Hubs, dealt, find_hubs, hubs_of, lookup, resident
from corepart.store import Store


def both_ends(edges: DataFrame) -> DataFrame:
    """One row per edge end, from a single scan of the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def vertices(edges: DataFrame) -> DataFrame:
    return both_ends(edges).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree with multiplicity; a self-loop counts twice."""
    return both_ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def graph_counts(edges: DataFrame) -> DataFrame:
    """Vertices and edges, from one aggregation over the edge ends."""
    return degrees(edges).agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.expr("sum(degree) div 2").alias("n_edges"),
    )


def with_unit_weight(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges: no loops, one row per pair, smaller id first."""
    ordered = drop_loops(edges).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    )
    return ordered.distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, nbr): every edge seen from both of its ends; a self-loop appears twice."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")),
    )
    return edges.select(F.inline(ends))


def weighted_adjacency(edges: DataFrame) -> DataFrame:
    """`adjacency` with parallel edges merged: w = how often the pair occurs.

    Edges are merged before they are doubled, so half as many rows are shuffled.
    """
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    w = pairs.agg(F.count(F.lit(1)).alias("w"))
    ends = F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("nbr"), "w"),
        F.struct(F.col("b").alias("id"), F.col("a").alias("nbr"), "w"),
    )
    return w.select(F.inline(ends))


def dense_ids(v: DataFrame) -> DataFrame:
    """(id, idx): 0-based index in id order; join on either column to go back and forth."""
    return dense_index(v.select("id"), ["id"], out="idx")


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """Text form for graph partitioners: a header `n m 000`, then 1-based neighbours per vertex.

    (line_no, line). The format puts a whole neighbour list on one line, so one line is
    as long as the largest degree.
    """
    store = Store(edges.sparkSession, "adjacency-lines")
    simple = store.save(undirected(edges), "simple")
    hubs = find_hubs(simple)
    ids = dense_ids(vertices(simple))
    nbrs = lookup(adjacency(simple), "nbr", ids.withColumnRenamed("idx", "nbr_idx"), hubs, ("id",))
    lists = nbrs.groupBy("id").agg(F.array_sort(F.collect_list(F.col("nbr_idx") + 1)).alias("l"))
    body = lists.join(ids, "id").select(
        (F.col("idx") + 1).alias("line_no"), F.array_join(F.col("l").cast("array<string>"), " ").alias("line")
    )
    header = graph_counts(simple).select(
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat_ws(" ", "n_vertices", "n_edges", F.lit("000")).alias("line"),
    )
    return header.unionByName(body)


PIECE = 1000  # neighbours of a vertex in one row on the way to a file


def adjacency_pieces(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """(line_no, at, first, value): the lines of `adjacency_lines` in rows of at most `piece` neighbours.

    Rows of all vertices are numbered in one order and cut at every multiple of `piece`, so
    a hub's list is many rows and never one value.
    """
    store = Store(edges.sparkSession, "adjacency-pieces")
    simple = store.save(undirected(edges), "simple")
    hubs = find_hubs(simple)
    ids = store.save(dense_index(vertices(simple), ["id"], out="idx", store=store), "ids")
    nbrs = lookup(adjacency(simple), "nbr", ids.withColumnRenamed("idx", "nbr_idx"), hubs, ("id",))
    nbrs = lookup(nbrs, "id", ids, hubs, ("nbr",)).select("idx", "nbr_idx")
    placed = store.save(dense_index(nbrs, ["idx", "nbr_idx"], store=store), "placed")
    cut = F.floor(F.col("pos") / piece).alias("cut")
    rows = placed.groupBy("idx", cut).agg(F.min("pos").alias("at"), F.array_sort(F.collect_list(F.col("nbr_idx") + 1)).alias("l"))
    starts = placed.groupBy("idx").agg(F.min("pos").alias("start"))
    text = F.array_join(F.col("l").cast("array<string>"), " ")
    body = rows.join(starts, "idx").select((F.col("idx") + 1).alias("line_no"), "at", (F.col("at") == F.col("start")).alias("first"), text.alias("value"))
    header = graph_counts(simple).select(
        F.lit(0).cast("bigint").alias("line_no"),
        F.lit(0).cast("bigint").alias("at"),
        F.lit(True).alias("first"),
        F.concat_ws(" ", "n_vertices", "n_edges", F.lit("000")).alias("value"),
    )
    out = store.save(header.unionByName(body), "pieces")
    store.keep_only("pieces")
    return out


def write_adjacency(edges: DataFrame, path: str, piece: int = PIECE) -> None:
    """The text form as files whose contents, one file after the other, are the whole.

    Rows are streamed in order with a blank after each; a line begins with its newline, so lines end with a blank. A vertex
    is in one file.
    """
    rows = adjacency_pieces(edges, piece).repartitionByRange("line_no").sortWithinPartitions("line_no", "at")
    newline = F.when(F.col("first") & (F.col("line_no") > 0), F.lit("\n")).otherwise(F.lit(""))
    rows.select(F.concat(newline, "value").alias("value")).write.option("lineSep", " ").text(path)


def read_adjacency(spark, path: str) -> DataFrame:
    """(line): the lines that `write_adjacency` wrote, without outer blanks."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


# --- joins between edges and vertex tables ------------------------------------------


def triplets(edges: DataFrame, v: DataFrame, attr: str, hubs: Hubs | None = None) -> DataFrame:
    """(src, dst, src_<attr>, dst_<attr>): every edge with the attribute of both ends."""
    table = v.select("id", attr)
    out = lookup(edges, "src", table.withColumnRenamed(attr, f"src_{attr}"), hubs, ("dst",))
    out = lookup(out, "dst", table.withColumnRenamed(attr, f"dst_{attr}"), hubs, ("src",))
    return out.select("src", "dst", f"src_{attr}", f"dst_{attr}")


def outer_join_vertices(v: DataFrame, other: DataFrame) -> DataFrame:
    return v.join(other, "id", "left")


def restrict(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in `ids`."""
    return df.join(ids.select("id"), "id", "left_semi")


def exclude(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in `ids`."""
    return df.join(ids.select("id"), "id", "left_anti")


def edge_parts(
    edges: DataFrame, assignment: DataFrame, hubs: Hubs | None = None, missing: int = -1
) -> DataFrame:
    """(src, dst, src_part, dst_part) with `missing` for an end that has no part."""
    table = assignment.select("id", "part")
    out = lookup(edges, "src", table.withColumnRenamed("part", "src_part"), hubs, ("dst",), how="left")
    out = lookup(out, "dst", table.withColumnRenamed("part", "dst_part"), hubs, ("src",), how="left")
    return out.select(
        "src",
        "dst",
        F.coalesce("src_part", F.lit(missing)).alias("src_part"),
        F.coalesce("dst_part", F.lit(missing)).alias("dst_part"),
    )


def intra_part_edges(edges: DataFrame, assignment: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """(part, src, dst): edges whose two ends have the same part."""
    table = assignment.select("id", "part")
    out = lookup(edges, "src", table, hubs, ("dst",))
    out = lookup(out, "dst", table.withColumnRenamed("part", "dst_part"), hubs, ("src",))
    return out.where(F.col("part") == F.col("dst_part")).select("part", "src", "dst")


def induced(edges: DataFrame, keep: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """Edges with both ends in `keep(id)`."""
    ids = keep.select("id").distinct()
    out = lookup(edges, "src", ids, hubs, ("dst",))
    out = lookup(out, "dst", ids, hubs, ("src",))
    return out.select("src", "dst")


def edge_sample(edges: DataFrame, p: float, seed: int | None = None, key=("src", "dst")) -> DataFrame:
    """Keep each row with probability p; with a seed the choice depends on `key` only."""
    if seed is None:
        return edges.sample(fraction=p)
    return edges.where(draw(*key, salt=f"{seed}:sample") < p)


# --- iterative operators ------------------------------------------------------------


SEND = 0.01  # of the tolerance: smaller changes wait until they have added up to it


def pagerank(
    edges: DataFrame,
    tol: float | None = 1e-4,
    max_iter: int | None = None,
    reset: float = 0.15,
    hubs: Hubs | None = None,
    history: list[dict] | None = None,
) -> DataFrame:
    """(id, rank) over directed edges; ranks are scaled to sum to the vertex count.

    Stops when no rank moves by more than `tol`, however many rounds that takes. With a `max_iter`,
    not to get there in so many rounds is an error; with tol=None exactly `max_iter` rounds run.
    Rank of vertices without out-edges is not handed on, as in the usual graph libraries.

    A round sends changes of ranks, not ranks: vertices whose rank has settled are silent, and so are
    those whose changes since they last spoke are within SEND times `tol` (all of these together move
    a rank by no more than a fraction of `tol`). Without a tolerance every change is sent. `history` gets a
    record per round: vertices that spoke, links they spoke along, the greatest change.
    """
    if tol is None and max_iter is None:
        raise ValueError("without a tolerance the number of rounds must be given")
    store = Store(edges.sparkSession, "pagerank")
    pairs = store.save(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "pairs")
    hubs = find_hubs(pairs) if hubs is None else hubs
    fans = store.save(pairs.groupBy("src").agg(F.sum("n").alias("out"), F.count(F.lit(1)).alias("fan")).withColumnRenamed("src", "id"), "fans")
    links = lookup(dealt(pairs, "src", hubs, ("dst",)), "src", fans.select("id", "out"), hubs, ("dst",))
    links = store.save(links.select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "links")
    links = resident(links, "src", hubs, ("dst",))
    ids = vertices(pairs).join(fans.select("id", "fan"), "id", "left")
    # Every rank starts at 1, and that is the first change; what no neighbour sends is `reset`.
    one, fan = F.lit(1.0), F.coalesce("fan", F.lit(0).cast("bigint")).alias("fan")
    state = store.save(ids.select("id", fan, F.lit(reset).alias("rank"), one.alias("waits")), "state-0")
    least = 0.0 if tol is None else SEND * tol
    speaks = (F.col("fan") > 0) & (F.abs("waits") > least)
    for i in count(1):
        speakers = state.where(speaks).select("id", "waits")
        sent = lookup(links, "src", speakers, hubs, ("dst",))
        received = sent.groupBy("dst").agg(F.sum(F.col("waits") * F.col("share")).alias("got"))
        got = F.lit(1.0 - reset) * F.coalesce("got", F.lit(0.0))
        change = F.lit(reset - 1.0) + got if i == 1 else got
        kept = F.when(speaks, F.lit(0.0)).otherwise(F.col("waits")) if i > 1 else F.lit(0.0)
        nxt = state.join(received.withColumnRenamed("dst", "id"), "id", "left").select(
            "id", "fan", (F.col("rank") + got).alias("rank"), (kept + change).alias("waits"), F.abs(change).alias("moved")
        )
        nxt = store.save(nxt, f"state-{i}")
        if history is not None:
            spoke, along = state.where(speaks).agg(F.count(F.lit(1)), F.coalesce(F.sum("fan"), F.lit(0))).first()
            history.append({"round": i, "speakers": spoke, "links": along, "moved": nxt.agg(F.max("moved")).first()[0]})
        store.drop(f"state-{i - 1}")
        state = nxt.drop("moved")
        moved = None if tol is None else nxt.agg(F.max("moved")).first()[0] or 0.0
        if moved is not None and moved <= tol:
            break
        if i == max_iter:
            if tol is None:
                break
            raise RuntimeError(f"not converged: after {i} rounds a rank still moved by {moved}")
    links.unpersist()
    store.keep_only(f"state-{i}")
    ranks = state.select("id", "rank")
    n, total = ranks.agg(F.count(F.lit(1)), F.sum("rank")).first()
    return ranks.withColumn("rank", F.col("rank") * F.lit(n / total)) if n else ranks


def random_score(v: DataFrame, seed: int) -> DataFrame:
    return v.select("id", draw("id", salt=f"{seed}:score").alias("score"))


FEW = 1 << 17  # edges between representatives that one task joins up, 2 MB


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst) to (id, rep): the least id that edges lead to, for every end."""
    parts = [(np.asarray(b.column("src")), np.asarray(b.column("dst"))) for b in batches]
    a, b = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "rep"])


def components(
    v: DataFrame, edges: DataFrame, hubs: Hubs | None = None, history: list[int] | None = None, few: int = FEW
) -> DataFrame:
    """(id, component): the least vertex id reachable over undirected edges.

    Edges are contracted: in a round every vertex joins the one that comes first, in a random
    order of the round, among itself and its neighbours. Edges are rewritten between these
    representatives, loops and repetitions go, and the next round has fewer of both. The representatives are then
    followed back from the last round to the first, with the least id of what they stand
    for. Rounds grow with the logarithm of the vertices, whatever the length of paths. When at most `few` edges are
    left, a single task joins them up. Vertices of `v` without an edge form their own
    component. `history` gets the edges of each round.
    """
    store = Store(v.sparkSession, "components")
    # Tables of vertices can be small as files and still many rows: their joins are told not to go through the driver.
    spread = lambda table: table.hint("merge")
    left, rounds = store.save(undirected(edges), "edges-0"), 0
    least = vertices(left).select("id", F.col("id").alias("least"))
    while (n := left.count()) > few:
        if history is not None:
            history.append(n)
        order = lambda c, salt=rounds: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("id"))
        # One aggregation: who comes first around a vertex, and how many edges it has.
        ends = F.array(F.struct(F.col("src").alias("id"), order("dst").alias("near")), F.struct(F.col("dst").alias("id"), order("src").alias("near")))
        near = left.select(F.inline(ends)).groupBy("id").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n"))
        joined = near.join(spread(least), "id").select("id", F.least("near", order("id"))["id"].alias("rep"), "least", "n")
        reps = store.save(joined, f"reps-{rounds}")
        big = hubs_of(reps, "n") if hubs is None or rounds else hubs
        moved = lookup(left, "src", reps.select("id", F.col("rep").alias("a")), big, ("dst",), hint="merge")
        moved = lookup(moved, "dst", reps.select("id", F.col("rep").alias("b")), big, ("src",), hint="merge")
        least = store.save(reps.groupBy(F.col("rep").alias("id")).agg(F.min("least").alias("least")), f"least-{rounds + 1}")
        rounds += 1
        left = store.save(undirected(moved.select(F.col("a").alias("src"), F.col("b").alias("dst"))), f"edges-{rounds}")
        store.drop(f"edges-{rounds - 1}")
    found = left.repartition(1).mapInArrow(_joined_up, "id bigint, rep bigint")  # at most `few` rows
    if rounds:
        last = store.save(found.join(spread(least), "id"), "last")
        tops = last.groupBy("rep").agg(F.min("least").alias("component"))
        found = last.join(spread(tops), "rep").select("id", "component")
    else:
        found = found.withColumnRenamed("rep", "component")
    for r in reversed(range(rounds)):
        # representatives that had no edge left stand for their own component
        known = store.read(f"least-{r + 1}").join(spread(found), "id", "left")
        found = known.select("id", F.coalesce("component", "least").alias("component"))
        reps = store.read(f"reps-{r}")
        counts = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("rep", "id")
        through = lookup(reps.select("id", "rep"), "rep", found, hubs_of(counts, "n"), ("id",), hint="merge").select("id", "component")
        found = store.save(through, f"found-{r}")
        store.drop(f"found-{r + 1}")
        store.drop(f"reps-{r}")
    out = v.select("id").distinct().join(spread(found), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    out = store.save(out, "components")
    store.keep_only("components")
    return out


def largest_component(comp: DataFrame) -> DataFrame:
    """One row (component, size): the largest; ties go to the lowest id."""
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    best = F.max(F.struct("size", (-F.col("component")).alias("neg")))
    return (
        sizes.agg(best.alias("b"))
        .where(F.col("b").isNotNull())
        .select((-F.col("b.neg")).alias("component"), F.col("b.size").alias("size"))
    )


def components_by_part(edges: DataFrame, assignment: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """(part, n_components): components of the subgraph inside each part, all parts in one run."""
    inner = intra_part_edges(edges, assignment, hubs).select("src", "dst")
    comp = components(assignment, inner, hubs)
    roots = comp.where(F.col("id") == F.col("component")).select("id")
    return restrict(assignment, roots).groupBy("part").agg(F.count(F.lit(1)).alias("n_components"))


def grow_core(edges: DataFrame, size: int, seed: int, hubs: Hubs | None = None) -> DataFrame:
    """(id, round): breadth-first growth from one random vertex to exactly `size` vertices.

    The whole frontier joins while it fits, else a random part of it. Stops early when the
    frontier is empty.
    """
    store = Store(edges.sparkSession, "grow-core")
    salt = f"{seed}:core"
    adj = store.save(adjacency(undirected(edges)), "adjacency")
    hubs = find_hubs(adj, "id") if hubs is None else hubs
    adj = resident(adj, "id", hubs, ("nbr",))
    first = vertices(edges).agg(F.min_by("id", F.struct(draw("id", salt=salt), "id")).alias("id"))
    core = store.save(first.where("id is not null").withColumn("round", F.lit(0)), "core-0")
    step = 0
    while True:
        step += 1
        newest = core.where(F.col("round") == step - 1).select("id")
        reached = lookup(adj, "id", newest, hubs, ("nbr",)).select(F.col("nbr").alias("id")).distinct()
        frontier = store.save(exclude(reached, core), f"frontier-{step}")
        have, found = core.count(), frontier.count()
        room = size - have
        if found == 0 or room <= 0:
            adj.unpersist()
            store.drop("adjacency")
            store.drop(f"frontier-{step}")
            return core
        if found > room:
            ranked = dense_index(frontier.withColumn("u", draw("id", salt=salt)), ["u", "id"])
            frontier = ranked.where(F.col("pos") < room).select("id")
        core = store.save(core.unionByName(frontier.withColumn("round", F.lit(step))), f"core-{step}")
        store.drop(f"core-{step - 1}")
        store.drop(f"frontier-{step}")


# --- rankings -----------------------------------------------------------------------


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores, ties by id (a report: k is small)."""
    return scores.orderBy(F.desc("score"), "id").limit(k)


def top_degree(edges: DataFrame, n: int) -> DataFrame:
    """The n highest degrees of the undirected graph without parallel edges (a loop counts
    twice), with n as a share of the vertex count."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    deg = Store(edges.sparkSession, "top-degree").save(degrees(pairs), "degrees")
    count = deg.count()
    top = deg.orderBy(F.desc("degree"), "id").limit(n)
    return top.withColumn("share", F.lit(n / count if count else 0.0))
