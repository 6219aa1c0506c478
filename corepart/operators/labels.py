"""Balanced label propagation: seeds, scores, proposals, migration.

`state(id, label INT, score DOUBLE)`; label 0 is the core, parts are 1..P. Candidate
labels of a vertex are one array with at most P + 1 entries, so scoring, the core bonus
and the choice of the best label all happen inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corepart.functions import draw, draw_int
from corepart.operators.order import running_total
from corepart.operators.skew import Hubs, lookup

DIGITS = 9  # scores are rounded before they are compared, so that equal scores are equal


def capacity(n: int, parts: int, slack: float, core_rate: float | None = None) -> dict[int, float]:
    """Capacity by label; with core_rate=None there is no core and labels are 0..P-1."""
    if core_rate is None:
        return {p: slack * n / parts for p in range(parts)}
    caps = {p: slack * n * (1.0 - core_rate) / parts for p in range(1, parts + 1)}
    return {0: slack * core_rate * n, **caps}


def by_label(table: dict[int, float], label: str | Column = "label") -> Column:
    """Look up a label in a P + 1 entry table (null when absent)."""
    label = F.col(label) if isinstance(label, str) else label
    pairs = [x for k, v in sorted(table.items()) for x in (F.lit(int(k)), F.lit(float(v)))]
    return F.create_map(*pairs)[label] if pairs else F.lit(None).cast("double")


def core_size(n: int, core_rate: float) -> int:
    """How many vertices the seed core aims at: three times the core rate."""
    k = int(3 * core_rate * n)
    if k == 0:
        raise ValueError(f"core rate {core_rate} is too small for {n} vertices: the seed core is empty")
    return k


def core_threshold(scores: DataFrame, k: int) -> float:
    """The k-th largest score.

    k grows with the graph, so no task and no driver may hold the k scores: equal scores
    are counted first, and a running total over the distinct ones finds the threshold.
    """
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts.withColumn("neg", -F.col("score")), ["neg"], "n")
    return ranked.where(F.col("upto") >= k).agg(F.max("score")).first()[0]


def seed_labels(scores: DataFrame, threshold: float, parts: int, seed: int) -> DataFrame:
    """Scores at or above the threshold (all ties) start in the core, others in a random part."""
    label = F.when(F.col("score") >= threshold, F.lit(0)).otherwise(
        draw_int("id", salt=f"{seed}:seed", k=parts, start=1)
    )
    return scores.select("id", label.cast("int").alias("label"), F.col("score").cast("double").alias("score"))


def seed_plain(v: DataFrame, parts: int, seed: int) -> DataFrame:
    return v.select("id", draw_int("id", salt=f"{seed}:seed", k=parts).alias("label"))


def part_size(state: DataFrame) -> DataFrame:
    return state.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def part_load(sizes: DataFrame, caps: dict[int, float]) -> DataFrame:
    """Size over capacity: above 1 the part is too full."""
    return sizes.select("label", (F.col("size") / by_label(caps)).alias("load"))


def part_score_mean(state: DataFrame) -> DataFrame:
    """Mean score by label, with each score truncated to a whole number first, and as is."""
    return state.groupBy("label").agg(
        (F.sum(F.col("score").cast("bigint")) / F.count(F.lit(1))).alias("mean_trunc_score"),
        F.avg("score").alias("mean_score"),
    )


def neigh_label_freq(adj: DataFrame, state: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """(id, label, cnt): how often each label occurs among a vertex's neighbours.

    `adj(id, nbr[, w])`; parallel edges count each time, and a self-loop counts twice.
    """
    w = F.col("w") if "w" in adj.columns else F.lit(1).cast("bigint")
    msgs = lookup(adj, "nbr", state.select("id", "label"), hubs, ("id",))
    return msgs.groupBy("id", "label").agg(F.sum(w).alias("cnt"))


def label_scores(freq: DataFrame, load: DataFrame, lam_edge: float, affinity: str = "floor") -> DataFrame:
    """(id, total, seen): one row per vertex; seen = array of (label, cnt, score).

    score = affinity + lam_edge * (1 - load). Affinity "floor" divides whole numbers: 1 when
    all neighbours share the label, else 0. "ratio" is the share of neighbours.
    """
    if affinity not in ("floor", "ratio"):
        raise ValueError("affinity is 'floor' or 'ratio'")
    grouped = (
        freq.join(F.broadcast(load), "label")  # load: one row per label
        .groupBy("id")
        .agg(F.sum("cnt").alias("total"), F.collect_list(F.struct("label", "cnt", "load")).alias("s"))
    )

    def scored(x: Column) -> Column:
        share = (
            (x["cnt"] == F.col("total")).cast("double")
            if affinity == "floor"
            else x["cnt"] / F.col("total")
        )
        score = F.round(share + F.lit(lam_edge) * (F.lit(1.0) - x["load"]), DIGITS)
        return F.struct(x["label"].alias("label"), x["cnt"].alias("cnt"), score.alias("score"))

    return grouped.select("id", "total", F.transform("s", scored).alias("seen"))


def label_counts(freq: DataFrame) -> DataFrame:
    """(id, counts): of each vertex the array of (label, cnt) among its neighbours, at most P + 1 entries."""
    return freq.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "cnt"))).alias("counts"))


def changed_counts(counts: str, changes: str) -> Column:
    """Counts with signed changes (both arrays of (label, cnt)) added; labels that reach 0 go. No changes: null."""
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(counts, lambda x: x["label"]), F.transform(changes, lambda x: x["label"]))))
    zero = F.lit(0).cast("bigint")

    def total(label: Column) -> Column:
        both = F.filter(F.concat(F.col(counts), F.col(changes)), lambda x: x["label"] == label)
        return F.struct(label.alias("label"), F.aggregate(both, zero, lambda s, x: s + x["cnt"]).alias("cnt"))

    added = F.filter(F.transform(labels, total), lambda x: x["cnt"] != 0)
    return F.when(F.col(changes).isNull(), F.col(counts)).otherwise(added)


def moved_counts(adj: DataFrame, moves: DataFrame, hubs: Hubs | None = None) -> DataFrame:
    """(id, changes): what the neighbours' moves (id, old_label, new_label) change in each vertex's counts."""
    near = lookup(adj, "nbr", moves.select("id", "old_label", "new_label"), hubs, ("id",))
    signed = F.array(
        F.struct(F.col("old_label").alias("label"), (-F.col("w")).alias("cnt")), F.struct(F.col("new_label").alias("label"), F.col("w").alias("cnt"))
    )
    rows = near.select("id", F.inline(signed)).groupBy("id", "label").agg(F.sum("cnt").alias("cnt"))
    return rows.groupBy("id").agg(F.collect_list(F.struct("label", "cnt")).alias("changes"))


def scores_of_counts(vertices: DataFrame, load: dict[int, float], lam_edge: float, affinity: str = "floor") -> DataFrame:
    """Add `seen` as `label_scores` gives it, from the vertex's own `counts`: nothing is joined."""
    if affinity not in ("floor", "ratio"):
        raise ValueError("affinity is 'floor' or 'ratio'")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x["cnt"])

    def scored(x: Column) -> Column:
        share = (x["cnt"] == F.col("total")).cast("double") if affinity == "floor" else x["cnt"] / F.col("total")
        score = F.round(share + F.lit(lam_edge) * (F.lit(1.0) - by_label(load, x["label"])), DIGITS)
        return F.struct(x["label"].alias("label"), x["cnt"].alias("cnt"), score.alias("score"))

    return vertices.withColumn("total", total).withColumn("seen", F.transform("counts", scored)).drop("total")


def _score_of(seen: str, label: Column) -> Column:
    """Score of a label in the array, 0 when the label is not there."""
    hit = F.filter(seen, lambda x: x["label"] == label)
    return F.coalesce(F.get(hit, F.lit(0))["score"], F.lit(0.0))


def core_candidate(
    scored: DataFrame, state: DataFrame, threshold: float | None = None, lam_rank: float = 0.0
) -> DataFrame:
    """Add candidate 0 to every vertex and join its own state: (id, label, score, seen, cands).

    Its score is the neighbours' score of label 0 (0 when absent) plus a bonus that grows with
    the vertex score; without a threshold there is no bonus.
    """
    return with_candidates(scored.join(state, "id"), threshold, lam_rank)


def with_candidates(joined: DataFrame, threshold: float | None = None, lam_rank: float = 0.0) -> DataFrame:
    """The same for rows that have their state already: adds `cands`."""
    bonus = F.lit(0.0) if threshold is None else F.lit(lam_rank) * (F.col("score") / F.lit(threshold) - 1.0)
    zero = F.struct(
        F.lit(0).alias("label"), F.round(_score_of("seen", F.lit(0)) + bonus, DIGITS).alias("score")
    )
    others = F.transform(
        F.filter("seen", lambda x: x["label"] != 0),
        lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")),
    )
    return joined.withColumn("cands", F.concat(others, F.array(zero)))


def propose(candidates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best candidate per vertex; it moves only if its own label's plain score is lower.

    Ties go to the lowest label. (id, old_label, new_label, score, best, cut_all, cut_real);
    the cut columns count the edge ends whose other end has another label; then the columns of `keep`.
    """
    best = F.array_max(
        F.transform("cands", lambda x: F.struct(x["score"].alias("score"), (-x["label"]).alias("neg")))
    )
    own = _score_of("seen", F.col("label"))
    away = F.filter("seen", lambda x: x["label"] != F.col("label"))
    away_real = F.filter(away, lambda x: (x["label"] != 0) & (F.col("label") != 0))

    def count(entries: Column) -> Column:
        return F.aggregate(entries, F.lit(0).cast("bigint"), lambda s, x: s + x["cnt"])

    score = F.col("score") if "score" in candidates.columns else F.lit(None).cast("double")
    return candidates.withColumn("b", best).select(
        "id",
        F.col("label").alias("old_label"),
        F.when(own < F.col("b.score"), -F.col("b.neg")).otherwise(F.col("label")).alias("new_label"),
        score.alias("score"),
        F.col("b.score").alias("best"),
        count(away).alias("cut_all"),
        count(away_real).alias("cut_real"),
        *keep,
    )


def explode_scores(df: DataFrame, column: str) -> DataFrame:
    """(id, label, score) from the `seen` or `cands` array."""
    return df.select("id", F.explode(column).alias("c")).select("id", "c.label", "c.score")


def movers(proposal: DataFrame) -> DataFrame:
    return proposal.where(F.col("old_label") != F.col("new_label"))


def demand(proposal: DataFrame) -> DataFrame:
    """(label, demand): vertices that want to move to the label."""
    return (
        movers(proposal)
        .groupBy(F.col("new_label").alias("label"))
        .agg(F.count(F.lit(1)).alias("demand"))
    )


def objective(proposal: DataFrame) -> DataFrame:
    """Sum of the best candidate score over all vertices (not the score of the adopted label)."""
    return proposal.agg(F.sum("best").alias("objective"))


def migration_prob(sizes: DataFrame, wanted: DataFrame, caps: dict[int, float]) -> DataFrame:
    """(label, prob): free room over demand; may be below 0 or above 1."""
    free = by_label(caps) - F.coalesce(F.col("size"), F.lit(0))
    return wanted.join(sizes, "label", "left").select("label", (free / F.col("demand")).alias("prob"))


def migrate(proposal: DataFrame, prob: dict[int, float], salt: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """New state, and the columns of `keep`: a mover changes its label if its draw is below the target's probability."""
    goes = draw("id", salt=salt) < by_label(prob, "new_label")
    label = F.when(F.col("old_label") == F.col("new_label"), F.col("old_label")).otherwise(
        F.when(goes, F.col("new_label")).otherwise(F.col("old_label"))
    )
    return proposal.select("id", label.alias("label"), "score", *keep)


def progress(value: float, best: float) -> float:
    """abs(1 - value / best), with infinity and NaN where the best is still 0."""
    if best == 0.0:
        return float("nan") if value == 0.0 else float("inf")
    return abs(1.0 - value / best)
