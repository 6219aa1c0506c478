"""Queries for label propagation and core extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corepart.checks.fixtures import *  # noqa: F403
from corepart.checks.graph_queries import recursive, sql_components, sql_pagerank
from corepart.checks.registry import query
from corepart.functions import rounded
from corepart.operators import graph, labels
from corepart.operators.skew import find_hubs
from corepart.plans import partition
from corepart.store import Store

# --- SQL for one round --------------------------------------------------------------

N = "(SELECT count(*) FROM v)"
CORE_CAP = (
    f"CASE WHEN label = 0 THEN {SLACK}::DOUBLE * {CORE_RATE}::DOUBLE * {N}"
    f" ELSE {SLACK}::DOUBLE * {N} * (1.0::DOUBLE - {CORE_RATE}::DOUBLE) / {PARTS} END"
)
PLAIN_CAP = f"{SLACK}::DOUBLE * {N} / {PARTS}"


def sql_threshold(scores: str, core_rate: float = CORE_RATE) -> str:
    return (
        f"SELECT min(score) AS t FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM {scores})"
        f" WHERE k <= floor(3 * {core_rate}::DOUBLE * {N})"
    )


def sql_seed(scores: str, threshold: str = "thr") -> str:
    return (
        f"SELECT id, CASE WHEN score >= (SELECT t FROM {threshold}) THEN 0"
        f" ELSE {sql_draw_int('id', salt=f'{SEED}:seed', k=PARTS, start=1)} END AS label,"
        f" score::DOUBLE AS score FROM {scores}"
    )


def sql_proposal(i: int, state: str, affinity: str, core: bool) -> list[tuple[str, str]]:
    """CTEs size, load, freq, sc (label scores), cand and pr (proposal) of round i."""
    cap = CORE_CAP if core else PLAIN_CAP
    share = "(f.cnt = t.total)::INTEGER::DOUBLE" if affinity == "floor" else "f.cnt::DOUBLE / t.total"
    bonus = f"{LAM_RANK}::DOUBLE * (s.score / (SELECT t FROM thr) - 1.0::DOUBLE)" if core else "0.0::DOUBLE"
    return [
        (f"size{i}", f"SELECT label, count(*) AS size FROM {state} GROUP BY label"),
        (f"load{i}", f"SELECT label, size / ({cap}) AS load FROM size{i}"),
        (
            f"freq{i}",
            f"SELECT adj.id, s.label, count(*) AS cnt FROM adj JOIN {state} s ON adj.nbr = s.id GROUP BY adj.id, s.label",
        ),
        (
            f"sc{i}",
            f"""SELECT f.id, f.label, round({share} + {LAM_EDGE}::DOUBLE * (1.0::DOUBLE - l.load), 9) AS score
            FROM freq{i} f JOIN (SELECT id, sum(cnt) AS total FROM freq{i} GROUP BY id) t ON t.id = f.id
            JOIN load{i} l ON l.label = f.label""",
        ),
        (
            f"cand{i}",
            f"""SELECT id, label, score FROM sc{i} WHERE label <> 0
            UNION ALL SELECT s.id, 0, round(coalesce(c.score, 0.0) + {bonus}, 9)
            FROM {state} s LEFT JOIN sc{i} c ON c.id = s.id AND c.label = 0""",
        ),
        (
            f"pr{i}",
            f"""SELECT s.id, s.label AS old_label,
              CASE WHEN coalesce(o.score, 0.0) < b.score THEN b.label ELSE s.label END AS new_label,
              s.score, b.score AS best
            FROM {state} s
            JOIN (SELECT id, label, score FROM cand{i}
                  QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1) b ON b.id = s.id
            LEFT JOIN sc{i} o ON o.id = s.id AND o.label = s.label""",
        ),
    ]


def sql_migration(i: int, core: bool) -> tuple[str, str]:
    cap = CORE_CAP if core else PLAIN_CAP
    return (
        f"prob{i}",
        f"""SELECT label, (({cap}) - coalesce(size, 0)) / demand AS prob
        FROM (SELECT new_label AS label, count(*) AS demand FROM pr{i} WHERE old_label <> new_label GROUP BY new_label) d
        LEFT JOIN size{i} USING (label)""",
    )


def sql_step(i: int, name: str) -> tuple[str, str]:
    return (
        name,
        f"""SELECT p.id, CASE WHEN p.old_label <> p.new_label
              AND {sql_draw('p.id', salt=f'{SEED}:migrate:{i}')} < m.prob THEN p.new_label ELSE p.old_label END AS label,
            p.score FROM pr{i} p LEFT JOIN prob{i} m ON m.label = p.new_label""",
    )


def sql_rounds(rounds: int, affinity: str, core: bool) -> list[tuple[str, str]]:
    """Unrolled rounds from state st0 to st<rounds>."""
    out = []
    for i in range(1, rounds + 1):
        out += sql_proposal(i, f"st{i - 1}", affinity, core)
        out += [sql_migration(i, core), sql_step(i, f"st{i}")]
    return out


DEGREE_SCORES = ("scores", "SELECT id, degree::DOUBLE AS score FROM deg")
THR = ("thr", sql_threshold("scores"))
TRADE = [edges_(SQL_TRADE), V, ADJ, DEG]
ROUND_1 = [*TRADE, LABELS, STATE, DEGREE_SCORES, THR]

# --- seeds --------------------------------------------------------------------------


@query("core_threshold", with_(*TRADE, DEGREE_SCORES, select=f"SELECT t AS threshold, floor(3 * {CORE_RATE}::DOUBLE * {N})::BIGINT AS k FROM ({sql_threshold('scores')})"))
def core_threshold(spark, sf):
    scores = partition.score_vertices(g_trade(spark, sf), "degree", SEED)
    k = labels.core_size(scores.count(), CORE_RATE)
    t = labels.core_threshold(scores, k)
    return scores.agg(F.max(F.lit(t)).alias("threshold"), F.max(F.lit(k).cast("bigint")).alias("k"))


@query("seed_degree", with_(*TRADE, DEGREE_SCORES, THR, select=sql_seed("scores")))
def seed_degree(spark, sf):
    return partition.seed_core(g_trade(spark, sf), PARTS, CORE_RATE, "degree", SEED)[0]


@query(
    "seed_random",
    with_(
        *TRADE, ("scores", f"SELECT id, {sql_draw('id', salt=f'{SEED}:score')} AS score FROM v"), THR,
        select=sql_seed("scores"),
    ),
)
def seed_random(spark, sf):
    return partition.seed_core(g_trade(spark, sf), PARTS, CORE_RATE, "random", SEED)[0]


@query(
    "seed_pagerank",
    with_(
        edges_(SQL_NEXT), V, *sql_pagerank(10),
        ("scores", f"SELECT id, {sql_round('rank', 9)} AS score FROM pr"), THR, select=sql_seed("scores"),
    ),
)
def seed_pagerank(spark, sf):
    ranks = graph.pagerank(g_next(spark, sf), tol=None, max_iter=10)
    scores = Store(spark, "seed-pagerank").save(ranks.select("id", rounded("rank", 9).alias("score")), "scores")
    t = labels.core_threshold(scores, labels.core_size(scores.count(), CORE_RATE))
    return labels.seed_labels(scores, t, PARTS, SEED)


@query(
    "seed_plain",
    with_(edges_(SQL_TRADE), V, select=f"SELECT id, {sql_draw_int('id', salt=f'{SEED}:seed', k=PARTS)} AS label FROM v"),
)
def seed_plain(spark, sf):
    return labels.seed_plain(graph.vertices(g_trade(spark, sf)), PARTS, SEED)


# --- one round, step by step --------------------------------------------------------


class Round:
    """The steps of one round from drawn labels and degree scores."""

    def __init__(self, spark, sf, affinity="floor", core=True):
        e = g_trade(spark, sf)
        self.state = Store(spark, "round").save(state0(e), "state")
        n = self.state.count()
        self.hubs = find_hubs(e)
        self.caps = labels.capacity(n, PARTS, SLACK, CORE_RATE if core else None)
        if not core:
            self.state = self.state.withColumn("label", F.col("label") % PARTS)
        self.sizes = labels.part_size(self.state)
        self.load = labels.part_load(self.sizes, self.caps)
        self.freq = labels.neigh_label_freq(graph.adjacency(e), self.state, self.hubs)
        self.scored = labels.label_scores(self.freq, self.load, LAM_EDGE, affinity)
        threshold = labels.core_threshold(self.state, labels.core_size(n, CORE_RATE)) if core else None
        self.cands = labels.core_candidate(self.scored, self.state, threshold, LAM_RANK)
        self.proposal = labels.propose(self.cands)


@query("part_size", with_(*ROUND_1, select="SELECT label, count(*) AS size FROM state0 GROUP BY label"))
def part_size(spark, sf):
    return Round(spark, sf).sizes


@query("part_load", with_(*ROUND_1, select=f"SELECT label, count(*) / ({CORE_CAP}) AS load FROM state0 GROUP BY label"))
def part_load(spark, sf):
    return Round(spark, sf).load


@query(
    "part_score_mean",
    with_(
        edges_(SQL_NEXT), V, LABELS,
        ("s", f"SELECT id, label, 5 * {sql_draw('id', salt=f'{SEED}:score')} AS score FROM labels0"),
        select=f"SELECT label, sum(trunc(score)::BIGINT)::DOUBLE / count(*) AS mean_trunc_score,"
        f" {sql_round('avg(score)')} AS mean_score FROM s GROUP BY label",
    ),
)
def part_score_mean(spark, sf):
    e = g_next(spark, sf)
    scores = graph.random_score(graph.vertices(e), SEED).withColumn("score", F.col("score") * 5)
    out = labels.part_score_mean(labels0(e).join(scores, "id"))
    return out.withColumn("mean_score", rounded("mean_score"))


@query(
    "neigh_label_freq",
    with_(
        edges_(SQL_NEXT), V, ADJ, LABELS,
        select="SELECT adj.id, label, count(*) AS cnt FROM adj JOIN labels0 l ON l.id = adj.nbr GROUP BY adj.id, label",
    ),
)
def neigh_label_freq(spark, sf):
    e = g_next(spark, sf)
    return labels.neigh_label_freq(graph.weighted_adjacency(e), labels0(e), find_hubs(e))


def _scores(df, column):
    return labels.explode_scores(df, column).withColumn("score", rounded("score"))


for _kind in ("floor", "ratio"):

    @query(
        f"label_scores_{_kind}",
        with_(
            *ROUND_1, *sql_proposal(1, "state0", _kind, True)[:4],
            select=f"SELECT id, label, {sql_round('score')} AS score FROM sc1",
        ),
    )
    def label_scores(spark, sf, kind=_kind):
        return _scores(Round(spark, sf, kind).scored, "seen")


@query(
    "label_scores_core",
    with_(
        *ROUND_1, *sql_proposal(1, "state0", "floor", True)[:5],
        select=f"SELECT id, label, {sql_round('score')} AS score FROM cand1",
    ),
)
def label_scores_core(spark, sf):
    return _scores(Round(spark, sf).cands, "cands")


def _proposal(r: Round):
    return r.proposal.select("id", "old_label", "new_label", rounded("best").alias("best"))


SQL_PROPOSED = f"SELECT id, old_label, new_label, {sql_round('best')} AS best FROM pr1"


@query("lp_propose", with_(*ROUND_1, *sql_proposal(1, "state0", "floor", True), select=SQL_PROPOSED))
def lp_propose(spark, sf):
    return _proposal(Round(spark, sf))


@query("lp_propose_ratio", with_(*ROUND_1, *sql_proposal(1, "state0", "ratio", True), select=SQL_PROPOSED))
def lp_propose_ratio(spark, sf):
    return _proposal(Round(spark, sf, "ratio"))


PLAIN_STATE = ("state1", f"SELECT id, label % {PARTS} AS label, score FROM state0")


@query(
    "lp_propose_plain",
    with_(*ROUND_1, PLAIN_STATE, *sql_proposal(1, "state1", "ratio", False), select=SQL_PROPOSED),
)
def lp_propose_plain(spark, sf):
    return _proposal(Round(spark, sf, "ratio", core=False))


@query(
    "lp_demand",
    with_(
        *ROUND_1, *sql_proposal(1, "state0", "ratio", True),
        select="SELECT new_label AS label, count(*) AS demand FROM pr1 WHERE old_label <> new_label GROUP BY new_label",
    ),
)
def lp_demand(spark, sf):
    return labels.demand(Round(spark, sf, "ratio").proposal)


@query(
    "lp_objective",
    with_(
        *ROUND_1, *sql_proposal(1, "state0", "ratio", True),
        select=f"SELECT {sql_round('sum(best)', 4)} AS objective FROM pr1",
    ),
)
def lp_objective(spark, sf):
    return labels.objective(Round(spark, sf, "ratio").proposal).select(rounded("objective", 4).alias("objective"))


@query(
    "lp_migration",
    with_(
        *ROUND_1, *sql_proposal(1, "state0", "ratio", True), sql_migration(1, True),
        select=f"SELECT label, {sql_round('prob')} AS prob FROM prob1",
    ),
)
def lp_migration(spark, sf):
    r = Round(spark, sf, "ratio")
    prob = labels.migration_prob(r.sizes, labels.demand(r.proposal), r.caps)
    return prob.withColumn("prob", rounded("prob"))


@query(
    "lp_step",
    with_(
        *ROUND_1, *sql_proposal(1, "state0", "ratio", True), sql_migration(1, True), sql_step(1, "st1"),
        select="SELECT id, label FROM st1",
    ),
)
def lp_step(spark, sf):
    r = Round(spark, sf, "ratio")
    prob = labels.migration_prob(r.sizes, labels.demand(r.proposal), r.caps)
    table = {p.label: p.prob for p in prob.collect()}  # one row per label
    return labels.migrate(r.proposal, table, f"{SEED}:migrate:1").select("id", "label")


# --- whole loops --------------------------------------------------------------------

CORE_START = [*TRADE, DEGREE_SCORES, THR, ("st0", sql_seed("scores"))]
PLAIN_START = [
    *TRADE,
    ("st0", f"SELECT id, {sql_draw_int('id', salt=f'{SEED}:seed', k=PARTS)} AS label, NULL::DOUBLE AS score FROM v"),
]


def run_core(spark, sf, rounds, affinity="floor"):
    return partition.partition_with_core(
        g_trade(spark, sf), PARTS, CORE_RATE, SLACK, "degree", LAM_EDGE, LAM_RANK,
        tol=0.0, max_rounds=rounds, seed=SEED, affinity=affinity,
    )


for _kind, _name in (("floor", "lp_core_3"), ("ratio", "lp_core_ratio_3")):

    @query(_name, with_(*CORE_START, *sql_rounds(3, _kind, True), select="SELECT id, label FROM st3"))
    def lp_core(spark, sf, kind=_kind):
        return run_core(spark, sf, 3, kind).state.select("id", "label")


@query("lp_plain_3", with_(*PLAIN_START, *sql_rounds(3, "ratio", False), select="SELECT id, label FROM st3"))
def lp_plain_3(spark, sf):
    out = partition.partition_plain(
        g_trade(spark, sf), PARTS, SLACK, LAM_EDGE, tol=0.0, max_rounds=3, seed=SEED, affinity="ratio"
    )
    return out.state.select("id", "label")


def _sql_trace(rounds: int) -> str:
    """One row per round: objective, progress against the best so far, and the cuts."""
    rows = []
    for i in range(1, rounds + 1):
        cut = (
            f"FROM e JOIN st{i - 1} a ON a.id = e.src JOIN st{i - 1} b ON b.id = e.dst WHERE a.label <> b.label"
        )
        rows.append(
            f"SELECT {i} AS round, (SELECT sum(best) FROM pr{i}) AS objective,"
            f" (SELECT count(*) {cut} AND a.label <> 0 AND b.label <> 0) AS cut_real,"
            f" (SELECT count(*) {cut}) AS cut_all"
        )
    return " UNION ALL ".join(rows)


@query(
    "lp_trace",
    with_(
        *CORE_START, *sql_rounds(3, "ratio", True), ("trace", _sql_trace(3)),
        ("best", "SELECT *, greatest(0.0, coalesce(max(objective) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS best FROM trace"),
        select=f"""SELECT round::INTEGER AS round, {sql_round('objective', 4)} AS objective,
        CASE WHEN best = 0 THEN 'inf'::DOUBLE ELSE {sql_round('abs(1.0 - objective / best)')} END AS progress,
        cut_real, cut_all FROM best""",
    ),
)
def lp_trace(spark, sf):
    t = run_core(spark, sf, 3, "ratio").trace()
    return t.select(
        "round", rounded("objective", 4).alias("objective"),
        F.when(F.col("progress") < 1e300, rounded("progress")).otherwise(F.col("progress")).alias("progress"),
        "cut_real", "cut_all",
    )


# --- core extraction ----------------------------------------------------------------

GEO_CORE = [
    edges_(SQL_GEO), V, LABELS,
    ("ce", "SELECT src, dst FROM e JOIN labels0 a ON src = a.id JOIN labels0 b ON dst = b.id WHERE a.label = 0 AND b.label = 0"),
    ("cv", "SELECT id FROM labels0 WHERE label = 0"),
    ("cadj", "SELECT src AS id, dst AS nbr FROM ce UNION ALL SELECT dst, src FROM ce"),
    sql_components("cv", "cadj"),
    ("top", "SELECT comp FROM cc GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1"),
    ("core", "SELECT id FROM cc WHERE comp = (SELECT comp FROM top)"),
]


@query("core_subgraph", with_(*GEO_CORE[:4], select="SELECT src, dst FROM ce"))
def core_subgraph(spark, sf):
    e = g_geo(spark, sf)
    return partition.core_subgraph(e, labels0(e), find_hubs(e))


@query("core_largest", recursive(*GEO_CORE, select="SELECT id FROM core"))
def core_largest(spark, sf):
    e = g_geo(spark, sf)
    return partition.largest_core(e, labels0(e))


@query(
    "core_mark",
    recursive(*GEO_CORE, select="SELECT id, CASE WHEN id IN (SELECT id FROM core) THEN 0 ELSE 1 END AS mark FROM v"),
)
def core_mark(spark, sf):
    e = g_geo(spark, sf)
    return partition.extract_core(e, labels0(e)).marks


@query(
    "noncore_edges",
    recursive(
        *GEO_CORE,
        select="SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM core) AND dst NOT IN (SELECT id FROM core)",
    ),
)
def noncore_edges(spark, sf):
    e = g_geo(spark, sf)
    return partition.extract_core(e, labels0(e)).edges


@query(
    "core_extract",
    recursive(
        *GEO_CORE,
        select="SELECT id, (SELECT count(*) FROM cv) AS candidates, (SELECT count(*) FROM core) AS kept FROM core",
    ),
)
def core_extract(spark, sf):
    e = g_geo(spark, sf)
    out = partition.extract_core(e, labels0(e))
    return out.core.select(
        "id", F.lit(out.candidates).cast("bigint").alias("candidates"), F.lit(out.kept).cast("bigint").alias("kept")
    )
