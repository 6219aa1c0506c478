"""Queries for routing edges and features to parts."""

from __future__ import annotations


from corepart.checks.fixtures import *  # noqa: F403
from corepart.checks.graph_queries import recursive, sql_components
from corepart.checks.registry import query, sql_values, values
from corepart.functions import draw_int, rounded
from corepart.operators import graph, route
from corepart.operators.skew import find_hubs

ROUTE = [edges_(SQL_TRADE), V, LABELS, ASSIGN]


@query("route_edges", with_(*ROUTE, ROUTED, select="SELECT part, src, dst FROM routed"))
def route_edges(spark, sf):
    e = g_trade(spark, sf)
    return route.route_edges(e, assignment0(e), PARTS, find_hubs(e))


@query(
    "part_core_edges",
    with_(
        ("all_e", SQL_NEXT),
        ("e", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM all_e"),
        V, LABELS, ASSIGN, ROUTED, select="SELECT part, src, dst FROM routed",
    ),
)
def part_core_edges(spark, sf):
    e = g_next(spark, sf)
    return route.part_with_core_edges(e, assignment0(e), PARTS, find_hubs(e))


@query(
    "replicate_core",
    with_(
        *ROUTE,
        select=f"""SELECT p.part::INTEGER AS part, e.src, e.dst FROM e JOIN asg a ON e.src = a.id JOIN asg b ON e.dst = b.id,
        (SELECT range AS part FROM range(1, {PARTS + 1})) p WHERE a.part = 0 AND b.part = 0""",
    ),
)
def replicate_core(spark, sf):
    e = g_trade(spark, sf)
    inner = graph.induced(e, assignment0(e).where("part = 0"), find_hubs(e))
    return route.replicate_core(inner, PARTS).select("part", "src", "dst")


def sql_missing(edges: str) -> list[tuple[str, str]]:
    """`full`: the assignment with parts for the unassigned vertices that can get one."""
    return [
        edges_(edges), V, LABELS, GAP,
        ("t", "SELECT e.src, e.dst, coalesce(a.part, -1) AS a, coalesce(b.part, -1) AS b FROM e LEFT JOIN gap a ON e.src = a.id LEFT JOIN gap b ON e.dst = b.id"),
        ("mv", "SELECT id FROM v WHERE id NOT IN (SELECT id FROM gap)"),
        ("madj", "SELECT src AS id, dst AS nbr FROM t WHERE a = -1 AND b = -1 UNION ALL SELECT dst, src FROM t WHERE a = -1 AND b = -1"),
        sql_components("mv", "madj"),
        ("touch", """SELECT src AS id FROM t WHERE a = -1 AND b IN (0, -1) UNION SELECT dst FROM t WHERE b = -1 AND a IN (0, -1)"""),
        ("full_asg", f"""SELECT id, part FROM gap UNION ALL
         SELECT id, {sql_draw_int('comp', salt=f'{SEED}:missing', k=PARTS, start=1)} FROM cc
         WHERE comp IN (SELECT comp FROM cc JOIN touch USING (id))"""),
    ]


@query("route_missing", recursive(*sql_missing(SQL_GEO), select="SELECT id, part FROM full_asg"))
def route_missing(spark, sf):
    e = g_geo(spark, sf)
    return route.assign_missing(e, assignment_gap(e), PARTS, SEED, find_hubs(e))


@query(
    "route_stats",
    recursive(
        *sql_missing(SQL_GEO), DEG,
        ("f", "SELECT coalesce(a.part, -1) AS a, coalesce(b.part, -1) AS b FROM e LEFT JOIN full_asg a ON e.src = a.id LEFT JOIN full_asg b ON e.dst = b.id"),
        select=f"""SELECT (SELECT count(*) FROM full_asg WHERE part = 0) AS n_core, (SELECT count(*) FROM full_asg) AS n_assigned,
        (SELECT count(*) FROM f WHERE NOT ((a = 0 AND b <> -1) OR (b = 0 AND a <> -1) OR (a = b AND a > 0))) AS n_cut,
        (SELECT count(*) FROM mv) AS n_missing,
        (SELECT {sql_round('avg(degree)')} FROM deg JOIN gap USING (id) WHERE part = 0) AS core_degree_mean""",
    ),
)
def route_stats(spark, sf):
    e = g_geo(spark, sf)
    out = route.route_stats(e, assignment_gap(e), PARTS, SEED, find_hubs(e))
    return out.withColumn("core_degree_mean", rounded("core_degree_mean"))


@query(
    "core_degree_mean",
    with_(*ROUTE, DEG, select=f"SELECT {sql_round('avg(degree)')} AS core_degree_mean FROM deg JOIN asg USING (id) WHERE part = 0"),
)
def core_degree_mean(spark, sf):
    e = g_trade(spark, sf)
    core = assignment0(e).where("part = 0")
    return route.core_degree_mean(e, core).select(rounded("core_degree_mean").alias("core_degree_mean"))


@query("part_report", with_(*ROUTE, select="SELECT part, count(*) AS n_vertices FROM asg GROUP BY part"))
def part_report(spark, sf):
    return route.part_report(assignment0(g_trade(spark, sf)))


@query(
    "combine_assignment",
    with_(
        *ROUTE,
        select=f"SELECT id, CASE WHEN part = 0 THEN 0 ELSE 1 + {sql_draw_int('id', salt='second', k=PARTS)} END AS part FROM asg",
    ),
)
def combine_assignment(spark, sf):
    a = assignment0(g_trade(spark, sf))
    rest = a.where("part <> 0").select("id", draw_int("id", salt="second", k=PARTS).alias("part"))
    return route.combine_assignment(a.where("part = 0").select("id"), rest)


@query(
    "part_features",
    with_(
        edges_(SQL_NEXT), V, LABELS, ASSIGN, SQL_FEAT,
        ("pf", f"""SELECT p.part::INTEGER AS part, id, feat FROM asg JOIN feat USING (id)
          JOIN (SELECT range AS part FROM range(1, {PARTS + 1})) p ON asg.part = 0 OR asg.part = p.part"""),
        select=sql_values("pf", "part, id", "feat"),
    ),
)
def part_features(spark, sf):
    e = g_next(spark, sf)
    return values(route.part_features(feat_map(spark, sf, e), assignment0(e), PARTS), ["part", "id"], "feat")


@query(
    "part_features_plain",
    with_(
        edges_(SQL_NEXT), V, LABELS, ASSIGN, SQL_FEAT,
        ("pf", "SELECT part, id, feat FROM asg JOIN feat USING (id)"),
        select=sql_values("pf", "part, id", "feat"),
    ),
)
def part_features_plain(spark, sf):
    e = g_next(spark, sf)
    return values(route.part_features(feat_map(spark, sf, e), assignment0(e)), ["part", "id"], "feat")
