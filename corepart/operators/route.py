"""Routing edges and features to parts, with the core copied into every part.

`assignment(id, part INT)`: part 0 is the core, 1..P are the parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corepart.functions import draw_int
from corepart.operators import graph
from corepart.operators.skew import Hubs, find_hubs, hubs_of, lookup
from corepart.store import Store


def all_parts(parts: int) -> Column:
    return F.sequence(F.lit(1), F.lit(parts))


def _targets(parts: int) -> Column:
    """Parts that get an edge: every part, one part, or none (a cut edge)."""
    a, b = F.col("src_part"), F.col("dst_part")
    return (
        F.when((a == 0) & (b == 0), all_parts(parts))
        .when((b == 0) & (a > 0), F.array(a))
        .when((a == 0) & (b > 0), F.array(b))
        .when((a == b) & (a > 0), F.array(a))
        .otherwise(F.array().cast("array<int>"))
    )


def replicate_core(df: DataFrame, parts: int) -> DataFrame:
    """Every row once per part 1..P."""
    return df.withColumn("part", F.explode(all_parts(parts)))


def route_edges(
    edges: DataFrame, assignment: DataFrame, parts: int, hubs: Hubs | None = None
) -> DataFrame:
    """(part, src, dst): core-core edges go to every part, core-other edges to the other's part,
    edges inside a part to that part; edges between parts and of unassigned vertices are cut."""
    return route_ends(graph.edge_parts(edges, assignment, hubs), parts)


def route_ends(ends: DataFrame, parts: int) -> DataFrame:
    """The same from edges (src, dst, src_part, dst_part) whose ends were looked up before."""
    return ends.select(F.explode(_targets(parts)).alias("part"), "src", "dst")


def cut_edges(triplets: DataFrame, ignore_core: bool = False, attr: str = "label") -> DataFrame:
    """Edges whose ends have different labels, optionally only where neither is the core."""
    a, b = F.col(f"src_{attr}"), F.col(f"dst_{attr}")
    cut = a != b
    return triplets.where(cut & (a != 0) & (b != 0) if ignore_core else cut)


def edge_cut(triplets: DataFrame, attr: str = "label") -> DataFrame:
    """One row (cut_real, cut_all) from one pass."""
    a, b = F.col(f"src_{attr}"), F.col(f"dst_{attr}")
    return triplets.agg(
        F.count_if((a != b) & (a != 0) & (b != 0)).alias("cut_real"),
        F.count_if(a != b).alias("cut_all"),
    )


def missing_vertices(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(id): vertices of the edge list without a part."""
    return graph.exclude(graph.vertices(edges), assignment)


def _open_ends(ends: DataFrame) -> DataFrame:
    """(id): the ends without a part of edges (src, dst, src_part, dst_part)."""
    each = F.array(F.struct(F.col("src").alias("id"), F.col("src_part").alias("p")), F.struct(F.col("dst").alias("id"), F.col("dst_part").alias("p")))
    return ends.select(F.explode(each).alias("e")).where("e.p = -1").select("e.id")


def place_missing(open_edges: DataFrame, parts: int, seed: int) -> DataFrame:
    """(id, part): a random part for unassigned vertices that touch the core or each other.

    `open_edges` are the edges (src, dst, src_part, dst_part) with at least one end without a part (-1); no others
    are needed. Unassigned vertices joined by an edge share one part, drawn on their least id.
    """
    a, b = F.col("src_part"), F.col("dst_part")
    loose = open_edges.where((a == -1) & (b == -1)).select("src", "dst")
    touching = _open_ends(open_edges.where((a <= 0) & (b <= 0))).distinct()  # -1 beside 0 or -1
    comp = graph.components(_open_ends(open_edges).distinct(), loose)
    reached = graph.restrict(comp, touching).select(F.col("component").alias("id")).distinct()
    sizes = comp.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    # one component may hold most of them
    kept = lookup(comp, "component", reached, hubs_of(sizes, "n"), ("id",))
    return kept.select("id", draw_int("component", salt=f"{seed}:missing", k=parts, start=1).alias("part"))


def assign_missing(
    edges: DataFrame, assignment: DataFrame, parts: int, seed: int, hubs: Hubs | None = None
) -> DataFrame:
    """`assignment` plus a part from `place_missing`.

    A vertex that touches only assigned non-core vertices stays unassigned: its edges are cut.
    """
    ends = graph.edge_parts(edges, assignment, hubs).where("src_part = -1 OR dst_part = -1")
    open_edges = Store(edges.sparkSession, "assign-missing").save(ends, "open")
    return assignment.select("id", "part").unionByName(place_missing(open_edges, parts, seed))


@dataclass
class Ends:
    """Edges with the parts of both ends, looked up once."""

    assignment: DataFrame  # (id, part), with the parts of vertices that had none
    ends: DataFrame  # (src, dst, src_part, dst_part), the same
    missing: int  # vertices that had none
    store: Store


def final_ends(edges: DataFrame, assignment: DataFrame, parts: int, seed: int, hubs: Hubs | None = None) -> Ends:
    """Look both ends of all edges up once; only edges with an open end meet the new parts."""
    store = Store(edges.sparkSession, "ends")
    ends = store.save(graph.edge_parts(edges, assignment, hubs), "first")
    is_open = F.expr("src_part = -1 OR dst_part = -1")
    open_edges = store.save(ends.where(is_open), "open")
    placed = store.save(place_missing(open_edges, parts, seed), "placed")
    near = find_hubs(open_edges)
    again = lookup(open_edges, "src", placed.withColumnRenamed("part", "a"), near, ("dst",), how="left")
    again = lookup(again, "dst", placed.withColumnRenamed("part", "b"), near, ("src",), how="left")
    again = again.select("src", "dst", F.coalesce("a", "src_part").alias("src_part"), F.coalesce("b", "dst_part").alias("dst_part"))
    full = store.save(assignment.select("id", "part").unionByName(placed), "assignment")
    missing = _open_ends(open_edges).distinct().count()
    return Ends(full, ends.where(~is_open).unionByName(again), missing, store)


def combine_assignment(core: DataFrame, parts: DataFrame) -> DataFrame:
    """Core vertices get part 0, a vertex of 0-based part p gets p + 1."""
    zero = core.select("id", F.lit(0).alias("part"))
    rest = parts.select("id", (F.col("part") + 1).cast("int").alias("part"))
    return zero.unionByName(rest)


def part_with_core_edges(
    edges: DataFrame, assignment: DataFrame, parts: int, hubs: Hubs | None = None
) -> DataFrame:
    """(part, src, dst): simple undirected edges and self-loops inside (part + core), for every part."""
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return route_edges(ends, assignment, parts, hubs)


def core_degree_mean(edges: DataFrame, core: DataFrame) -> DataFrame:
    """One row (core_degree_mean): over core vertices that occur in the edge list."""
    return graph.restrict(graph.degrees(edges), core).agg(F.avg("degree").alias("core_degree_mean"))


def core_degree_of(ends: DataFrame) -> DataFrame:
    """One row (core_degree_mean) from edges whose ends were looked up before."""
    each = F.array(F.struct(F.col("src").alias("id"), F.col("src_part").alias("p")), F.struct(F.col("dst").alias("id"), F.col("dst_part").alias("p")))
    degree = ends.select(F.inline(each)).where("p = 0").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return degree.agg(F.avg("degree").alias("core_degree_mean"))


def route_stats(
    edges: DataFrame, assignment: DataFrame, parts: int, seed: int, hubs: Hubs | None = None
) -> DataFrame:
    """One row of the routing report: n_core, n_cut, n_missing, n_assigned, core_degree_mean."""
    found = final_ends(edges, assignment, parts, seed, hubs)
    cut = found.ends.agg(F.count_if(F.size(_targets(parts)) == 0).alias("n_cut"))
    sizes = found.assignment.agg(
        F.count_if(F.col("part") == 0).alias("n_core"), F.count(F.lit(1)).alias("n_assigned")
    )
    one = F.lit(1).alias("_one")
    out = sizes.withColumns({"n_missing": F.lit(found.missing).cast("bigint"), "_one": one})
    for row in (cut, core_degree_of(found.ends)):  # single rows
        out = out.join(F.broadcast(row.withColumn("_one", one)), "_one")
    return out.drop("_one")


def part_report(assignment: DataFrame) -> DataFrame:
    """(part, n_vertices), part 0 being the core."""
    return assignment.groupBy("part").agg(F.count(F.lit(1)).alias("n_vertices"))


def part_features(feats: DataFrame, assignment: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, id, feat): features by part; with `parts` the core's rows go to every part."""
    if parts is not None:
        target = F.when(F.col("part") == 0, all_parts(parts)).otherwise(F.array("part"))
        assignment = assignment.select("id", F.explode(target).alias("part"))
    return assignment.join(feats, "id").select("part", "id", "feat")


def missing_features(part_ids: DataFrame, feats: DataFrame, show: int = 20) -> None:
    """Raise when a vertex of a part has no features, naming some of the ids."""
    lost = graph.exclude(part_ids.select("id").distinct(), feats).limit(show).collect()
    if lost:
        raise ValueError(f"no features for vertices {sorted(r.id for r in lost)} (at most {show} shown)")
