"""From an edge list and a core to part files: partition the rest, place loose vertices, route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepart import sources
from corepart.operators import graph, route
from corepart.operators.skew import Hubs, find_hubs
from corepart.plans import partition
from corepart.store import Store


@dataclass
class Split:
    assignment: DataFrame  # (id, part): 0 is the core, 1..P the parts
    part_edges: DataFrame  # (part, src, dst)
    report: dict

    def write(self, path: str, feats: DataFrame | None = None, parts: int | None = None, named: bool = False) -> None:
        """Edge files under `path`/edges and feature files under `path`/feats, one folder per part.

        With `named` also `path`/part_0.txt, part_1.txt, ... and, with features, part_0.txt.feat, ...
        """
        if named:
            sources.write_named_parts(self.part_edges, path, parts=self.report["parts"])
            if feats is not None:
                rows = route.part_features(feats, self.assignment, parts or self.report["parts"])
                sources.write_named_features(rows, path, parts=self.report["parts"])
        sources.write_parts(self.part_edges, f"{path}/edges")
        if feats is not None:
            rows = route.part_features(feats, self.assignment, parts or self.report["parts"])
            sources.write_part_features(rows, f"{path}/feats")


def route_split(
    edges: DataFrame, assignment: DataFrame, parts: int, seed: int = 0, hubs: Hubs | None = None
) -> Split:
    """Route all edges by a given assignment, after giving loose vertices a part."""
    hubs = find_hubs(edges) if hubs is None else hubs
    store = Store(edges.sparkSession, "split")
    found = route.final_ends(edges, assignment, parts, seed, hubs)
    full, routed = store.save(found.assignment, "assignment"), store.save(route.route_ends(found.ends, parts), "edges")
    cut = route.cut_edges(found.ends, ignore_core=True, attr="part")
    sizes = {r.part: r.n_vertices for r in route.part_report(full).collect()}  # one row per part
    report = {
        "parts": parts,
        "core": sizes.get(0, 0),
        "sizes": sizes,
        "cut": cut.count(),
        "missing": found.missing,
        "core_degree_mean": route.core_degree_of(found.ends).first()[0],
    }
    found.store.keep_only()
    return Split(full, routed, report)


def split_graph(
    edges: DataFrame,
    core: DataFrame,
    parts: int,
    slack: float = 1.05,
    tol: float = 1e-3,
    max_rounds: int = 20,
    seed: int = 0,
    affinity: str = "ratio",
    lam_edge: float = 1.0,
) -> Split:
    """Partition the graph outside the core by label propagation, then route every edge.

    The core may come from `partition.extract_core` or from `graph.grow_core`.
    """
    hubs = find_hubs(edges)
    core = core.select("id")
    rest = partition.noncore_edges(edges, core, hubs)
    rest = Store(edges.sparkSession, "split-rest").save(graph.undirected(rest), "edges")
    placed = partition.partition_plain(rest, parts, slack, lam_edge, tol=tol, max_rounds=max_rounds, seed=seed, affinity=affinity)
    return route_split(edges, route.combine_assignment(core, placed.assignment()), parts, seed, hubs)


def split_plain(edges: DataFrame, assignment: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """(part, src, dst) without a core: edges inside a part; part numbers as given (from 0)."""
    return graph.intra_part_edges(edges, assignment, find_hubs(edges) if hubs is None else hubs)
