"""Label propagation to convergence, and extraction of the core."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepart.operators import graph, labels
from corepart.operators.skew import Hubs, find_hubs, hubs_of, resident
from corepart.store import Store


@dataclass
class Partitioning:
    """Final `state(id, label, score)` and one report row per round."""

    state: DataFrame
    report: list[dict] = field(default_factory=list)
    converged: bool = False

    def assignment(self) -> DataFrame:
        return self.state.select("id", F.col("label").alias("part"))

    def trace(self) -> DataFrame:
        """The scalar columns of the report as a DataFrame."""
        rows = [(r["round"], r["objective"], r["progress"], r["cut_real"], r["cut_all"]) for r in self.report]
        spark = self.state.sparkSession
        return spark.createDataFrame(
            rows, "round int, objective double, progress double, cut_real bigint, cut_all bigint"
        )


def score_vertices(
    edges: DataFrame, strategy: str, seed: int, hubs: Hubs | None = None, deg: DataFrame | None = None
) -> DataFrame:
    """(id, score) by "pagerank" or "degree"; any other name gives random scores."""
    if strategy == "pagerank":
        return graph.pagerank(edges, hubs=hubs).withColumnRenamed("rank", "score")
    deg = graph.degrees(edges) if deg is None else deg
    if strategy == "degree":
        return deg.select("id", F.col("degree").cast("double").alias("score"))
    return graph.random_score(deg, seed)


def seed_core(
    edges: DataFrame,
    parts: int,
    core_rate: float,
    strategy: str,
    seed: int,
    hubs: Hubs | None = None,
    deg: DataFrame | None = None,
) -> tuple[DataFrame, float, int]:
    """Seed state, core threshold and vertex count."""
    store = Store(edges.sparkSession, "seed-core")
    scores = store.save(score_vertices(edges, strategy, seed, hubs, deg), "scores")
    n = scores.count()
    threshold = labels.core_threshold(scores, labels.core_size(n, core_rate))
    return labels.seed_labels(scores, threshold, parts, seed), threshold, n


def _propagate(
    edges: DataFrame,
    state: DataFrame,
    caps: dict[int, float],
    lam_edge: float,
    affinity: str,
    threshold: float | None,
    lam_rank: float,
    tol: float,
    max_rounds: int,
    seed: int,
    hubs: Hubs,
) -> Partitioning:
    store = Store(edges.sparkSession, "propagate")
    # merged once and kept partitioned by neighbour: only moves are sent along it
    adj = resident(store.save(graph.weighted_adjacency(edges), "adjacency"), "nbr", hubs, ("id",))
    state = store.save(state, "state-0")
    counts = labels.label_counts(labels.neigh_label_freq(adj, state, hubs))
    # A vertex keeps its label and its neighbours' label counts in one row, in buckets of its id. A round
    # scores rows where they are; what is shuffled are the movers and what they change.
    rows = store.save_bucketed(state.join(counts, "id"), "vertices-0", ["id"])
    now = Counter({r.label: r.size for r in labels.part_size(rows).collect()})  # P + 1 rows
    out, best = Partitioning(state), 0.0
    try:
        for r in range(1, max_rounds + 1):
            load = {p: n / caps[p] for p, n in now.items()}
            scored = labels.scores_of_counts(rows, load, lam_edge, affinity)
            proposal = labels.propose(labels.with_candidates(scored, threshold, lam_rank), ("counts",))
            proposal = store.save_bucketed(proposal, f"proposal-{r}", ["id"], placed=True)
            # at most (P + 1)^2 rows: sizes, demand, objective and cuts in one pass
            cells = proposal.groupBy("old_label", "new_label").agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("best").alias("best"),
                F.sum("cut_all").alias("cut_all"),
                F.sum("cut_real").alias("cut_real"),
                F.sum(F.col("score").cast("bigint")).alias("trunc_score"),
            )
            sizes, wanted, trunc = {}, {}, {}
            value, cut_all, cut_real = 0.0, 0, 0
            for c in sorted(cells.collect(), key=lambda c: (c.old_label, c.new_label)):
                sizes[c.old_label] = sizes.get(c.old_label, 0) + c.n
                trunc[c.old_label] = trunc.get(c.old_label, 0) + (c.trunc_score or 0)
                if c.old_label != c.new_label:
                    wanted[c.new_label] = wanted.get(c.new_label, 0) + c.n
                value += c.best
                cut_all += c.cut_all
                cut_real += c.cut_real
            prob = {p: (caps[p] - sizes.get(p, 0)) / n for p, n in wanted.items()}
            placed = labels.migrate(proposal, prob, f"{seed}:migrate:{r}", ("old_label", "counts"))
            moves = placed.where(F.col("old_label") != F.col("label")).withColumnRenamed("label", "new_label")
            went = moves.groupBy("old_label", "new_label").agg(F.count(F.lit(1)).alias("n")).collect()  # at most (P + 1)^2
            now = Counter(sizes)
            for m in went:
                now[m.old_label] -= m.n
                now[m.new_label] += m.n
            now = Counter({p: n for p, n in now.items() if n})
            moved = labels.progress(value, best)
            out.report.append(
                {
                    "round": r,
                    "sizes": sizes,
                    "load": {p: s / caps[p] for p, s in sizes.items()},
                    "mean_trunc_score": {p: t / sizes[p] for p, t in trunc.items()},
                    "cut_real": cut_real // 2,  # both ends of a cut edge count it
                    "cut_all": cut_all // 2,
                    "demand": wanted,
                    "prob": prob,
                    "objective": value,
                    "progress": moved,
                    "moved": sum(m.n for m in went),
                }
            )
            changes = labels.moved_counts(adj, moves, hubs)
            rows = placed.drop("old_label").join(changes, "id", "left")
            rows = rows.withColumn("counts", labels.changed_counts("counts", "changes")).drop("changes")
            store.drop("vertices-0" if r == 1 else f"proposal-{r - 1}")
            if moved < tol:
                out.converged = True
                break
            best = max(best, value)
        out.state = store.save(placed.select("id", "label", "score"), "state")
    finally:
        adj.unpersist()
        store.keep_only("state")
    return out


def partition_with_core(
    edges: DataFrame,
    parts: int,
    core_rate: float,
    slack: float = 1.05,
    strategy: str = "degree",
    lam_edge: float = 1.0,
    lam_rank: float = 0.5,
    tol: float = 1e-3,
    max_rounds: int = 20,
    seed: int = 0,
    affinity: str = "floor",
    hubs: Hubs | None = None,
) -> Partitioning:
    """Label propagation with a core: labels 1..P and core 0.

    `max_rounds` counts real rounds; a loop whose counter moves twice per round runs half as many.
    """
    # one pass over the edges gives the hubs, the vertices and the degree scores
    deg = Store(edges.sparkSession, "degrees").save(graph.degrees(edges), "degrees")
    hubs = hubs_of(deg, "degree") if hubs is None else hubs
    state, threshold, n = seed_core(edges, parts, core_rate, strategy, seed, hubs, deg)
    caps = labels.capacity(n, parts, slack, core_rate)
    return _propagate(
        edges, state, caps, lam_edge, affinity, threshold, lam_rank, tol, max_rounds, seed, hubs
    )


def partition_plain(
    edges: DataFrame,
    parts: int,
    slack: float = 1.05,
    lam_edge: float = 1.0,
    tol: float = 1e-3,
    max_rounds: int = 20,
    seed: int = 0,
    affinity: str = "floor",
    hubs: Hubs | None = None,
) -> Partitioning:
    """Label propagation without a core: labels 0..P-1. Label 0 is still always a candidate."""
    v = Store(edges.sparkSession, "degrees").save(graph.degrees(edges), "degrees")
    hubs = hubs_of(v, "degree") if hubs is None else hubs
    caps = labels.capacity(v.count(), parts, slack)
    state = labels.seed_plain(v, parts, seed).withColumn("score", F.lit(None).cast("double"))
    return _propagate(edges, state, caps, lam_edge, affinity, None, 0.0, tol, max_rounds, seed, hubs)


# --- core extraction ----------------------------------------------------------------


@dataclass
class Core:
    core: DataFrame  # (id)
    edges: DataFrame  # edges with both ends outside the core
    marks: DataFrame  # (id, mark): 0 in the core, 1 elsewhere
    candidates: int
    kept: int


def core_subgraph(edges: DataFrame, state: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """Edges between vertices labelled 0."""
    return graph.induced(edges, state.where(F.col("label") == 0), hubs)


def largest_core(edges: DataFrame, state: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """(id): the largest connected component of the label-0 vertices; ties go to the lowest id."""
    members = state.where(F.col("label") == 0).select("id")
    comp = graph.components(members, core_subgraph(edges, state, hubs))
    biggest = graph.largest_component(comp).select("component")  # one row
    return comp.join(F.broadcast(biggest), "component", "left_semi").select("id")


def mark_core(v: DataFrame, core: DataFrame) -> DataFrame:
    """(id, mark): 0 for core vertices, 1 for all others."""
    marked = graph.outer_join_vertices(v.select("id"), core.select("id", F.lit(0).alias("mark")))
    return marked.select("id", F.coalesce("mark", F.lit(1)).alias("mark"))


def noncore_edges(edges: DataFrame, core: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """Edges with neither end in the core."""
    ends = graph.edge_parts(edges, core.select("id", F.lit(0).alias("part")), hubs, missing=1)
    return ends.where((F.col("src_part") == 1) & (F.col("dst_part") == 1)).select("src", "dst")


def extract_core(edges: DataFrame, state: DataFrame, hubs: Hubs | None = None) -> Core:
    """Largest connected core, the edges outside it, and the core size before and after."""
    hubs = find_hubs(edges) if hubs is None else hubs
    store = Store(edges.sparkSession, "extract-core")
    core = store.save(largest_core(edges, state, hubs), "core")
    return Core(
        core=core,
        edges=noncore_edges(edges, core, hubs),
        marks=mark_core(state, core),
        candidates=state.where(F.col("label") == 0).count(),
        kept=core.count(),
    )
