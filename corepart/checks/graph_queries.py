"""Queries for scans, graph operators and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corepart import sources
from corepart.checks.fixtures import *  # noqa: F403
from corepart.checks.registry import query, sql_values, values
from corepart.functions import rounded
from corepart.operators import graph, order, route
from corepart.operators.skew import find_hubs
from corepart.plans import partition
from corepart.store import Store

# --- scans and sinks ----------------------------------------------------------------


@query(
    "clean_edges",
    f"""WITH raw AS ({SQL_RAW}),
    t AS (SELECT regexp_split_to_array(regexp_replace(value, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), ' +') AS t FROM raw),
    n AS (SELECT try_cast(t[1] AS DOUBLE) AS a, try_cast(t[2] AS DOUBLE) AS b FROM t WHERE len(t) = 2)
    SELECT trunc(a)::BIGINT AS src, trunc(b)::BIGINT AS dst FROM n
    WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)""",
)
def clean_edges(spark, sf):
    return sources.clean_edges(raw_lines(spark, sf))


@query("edge_scan", "SELECT user_id AS src, event_id AS dst FROM events WHERE event_id % 19 <> 0")
def edge_scan(spark, sf):
    n = F.col("event_id")
    line = F.concat_ws("\t", F.col("user_id").cast("string"), n.cast("string"))
    lines = table(spark, sf, "events").select(
        F.when(n % 19 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")
    )
    path = Store(spark, "edge-scan").path("edges")
    lines.write.text(path)
    return sources.read_edges(spark, path)


@query("assignment_scan", with_(edges_(SQL_TRADE), V, LABELS, select="SELECT id, label AS part FROM labels0"))
def assignment_scan(spark, sf):
    path = Store(spark, "assignment-scan").path("assignment")
    a = assignment0(g_trade(spark, sf))
    a.select(F.concat_ws(" ", "id", "part").alias("value")).write.text(path)
    return sources.read_assignment(spark, path)


@query("line_index", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, value FROM ({SQL_RAW})")
def line_index(spark, sf):
    path = Store(spark, "line-scan").path("lines")
    lines = raw_lines(spark, sf).repartitionByRange("event_id").sortWithinPartitions("event_id")
    lines.select("value").write.text(path)
    return sources.line_index(spark, path)


@query(
    "features_scan",
    "WITH f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding AS feat FROM embeddings) "
    + sql_values("f", "id", "feat"),
)
def features_scan(spark, sf):
    path = Store(spark, "feature-scan").path("features")
    rows = feat64(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    rows.select(F.array_join(F.col("feat").cast("array<string>"), " ").alias("value")).write.text(path)
    return values(sources.read_features(spark, path), ["id"], "feat")


@query("emb_parse", with_(SQL_PART_EMB, select=sql_values("pe", "part, id", "vec")))
def emb_parse(spark, sf):
    line = F.concat(F.col("id").cast("string"), F.lit("  "), F.array_join(F.col("vec").cast("array<string>"), "   "), F.lit("\t"))
    lines = part_emb(spark, sf).select("part", line.alias("value"))
    return values(sources.parse_embeddings(lines), ["part", "id"], "vec")


@query(
    "emb_format",
    "WITH m AS (SELECT vec_id AS id, embedding AS vec FROM embeddings) " + sql_values("m", "id", "vec"),
)
def emb_format(spark, sf):
    lines = sources.format_embeddings(feat64(spark, sf), "feat")
    return values(sources.parse_embeddings(lines), ["id"], "vec")


@query(
    "part_files",
    with_(edges_(SQL_TRADE), V, LABELS, ASSIGN, ROUTED, select="SELECT part, src, dst FROM routed"),
)
def part_files(spark, sf):
    e = g_trade(spark, sf)
    routed = route.route_edges(e, assignment0(e), PARTS, find_hubs(e))
    path = Store(spark, "part-files").path("parts")
    sources.write_parts(routed, path)
    return sources.read_parts(spark, path)


@query(
    "part_manifest",
    with_(
        edges_(SQL_TRADE), V, LABELS, ASSIGN, ROUTED,
        select=f"SELECT part, 'file=' || (part - 1) AS folder, 3 AS epoch, count(*) AS n_edges FROM routed"
        f" WHERE part <= {PARTS} GROUP BY part",
    ),
)
def part_manifest(spark, sf):
    """Every path of the manifest is opened and its lines are counted."""
    e = g_trade(spark, sf)
    path = Store(spark, "part-manifest").path("parts")
    sources.write_parts(route.route_edges(e, assignment0(e), PARTS, find_hubs(e)), path)
    rows = sources.part_manifest(spark, PARTS, path, epoch=3).collect()  # PARTS rows
    out = None
    for r in rows:
        lines = spark.read.text(r.path).agg(F.count(F.lit(1)).alias("n_edges"))
        one = lines.select(F.lit(r.part).alias("part"), F.lit(r.path.rsplit("/", 1)[1]).alias("folder"), F.lit(r.epoch).alias("epoch"), "n_edges")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "part_txt_files",
    with_(edges_(SQL_TRADE), V, LABELS, ASSIGN, ROUTED, select=f"SELECT part, src, dst, 'part_' || (part - 1) || '.txt' AS file FROM routed WHERE part <= {PARTS}"),
)
def part_txt_files(spark, sf):
    """Every file that the manifest names is read back, line by line."""
    e = g_trade(spark, sf)
    path = Store(spark, "part-txt").root
    sources.write_named_parts(route.route_edges(e, assignment0(e), PARTS, find_hubs(e)), path, parts=PARTS)
    rows = sources.named_manifest(spark, PARTS, path, epoch=0).collect()  # PARTS rows
    back = sources.parse_edges(spark.read.text([r.path for r in rows]).withColumn("file", F.col("_metadata.file_name")), keep=("file",))
    names = spark.createDataFrame([(r.part, r.path.rsplit("/", 1)[1]) for r in rows], "part int, file string")
    return back.join(F.broadcast(names), "file").select("part", "src", "dst", "file")


@query(
    "part_txt_feats",
    with_(
        edges_(SQL_NEXT), V, LABELS, ASSIGN, SQL_FEAT,
        ("pf", f"SELECT p.range::INTEGER AS part, f.id, f.feat FROM asg a JOIN feat f USING (id), range(1, {PARTS} + 1) p WHERE a.part = 0 OR a.part = p.range"),
        select=sql_values("pf", "part, id", "feat"),
    ),
)
def part_txt_feats(spark, sf):
    """The feature files hold the core's rows in every part."""
    e = g_next(spark, sf)
    path = Store(spark, "part-feats").root
    rows = route.part_features(feat_map(spark, sf, e), assignment0(e), PARTS)
    sources.write_named_features(rows, path, parts=PARTS)
    return values(sources.read_named_features(spark, path), ["part", "id"], "feat")


@query("edges_round_trip", with_(edges_(SQL_NEXT), select="SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst"))
def edges_round_trip(spark, sf):
    """Edges written as lines and read back, repetitions included."""
    path = Store(spark, "edge-lines").path("edges")
    sources.write_edges(g_next(spark, sf), path)
    return sources.read_edges(spark, path, n_parts=8).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("core_round_trip", with_(edges_(SQL_NEXT), V, LABELS, select="SELECT id, 0 AS part FROM labels0 WHERE label = 0"))
def core_round_trip(spark, sf):
    """Core vertices written as `id 0` lines and read back."""
    path = Store(spark, "core-lines").path("core")
    sources.write_core(assignment0(g_next(spark, sf)).where("part = 0"), path)
    return sources.read_core(spark, path)


@query(
    "noncore_round_trip",
    with_(edges_(SQL_NEXT), V, LABELS, ("core", "SELECT id FROM labels0 WHERE label = 0"),
          select="SELECT src, dst, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM core) AND dst NOT IN (SELECT id FROM core) GROUP BY src, dst"),
)
def noncore_round_trip(spark, sf):
    """The edges outside the core, written and read back."""
    e = g_next(spark, sf)
    path = Store(spark, "noncore-lines").path("edges")
    sources.write_edges(partition.noncore_edges(e, assignment0(e).where("part = 0").select("id")), path)
    return sources.read_edges(spark, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    "adjacency_file",
    with_(
        edges_(SQL_NEXT),
        ("u", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst"),
        ("a", "SELECT src AS id, dst AS nbr FROM u UNION ALL SELECT dst, src FROM u"),
        ("ids", "SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM a)"),
        select="""SELECT (SELECT count(*) FROM ids) || ' ' || (SELECT count(*) FROM u) || ' 000' AS line
        UNION ALL SELECT string_agg(j.n::VARCHAR, ' ' ORDER BY j.n) FROM a JOIN ids i ON a.id = i.id
        JOIN ids j ON a.nbr = j.id GROUP BY i.n""",
    ),
)
def adjacency_file(spark, sf):
    """Lines streamed to files in rows of twenty neighbours, and read back."""
    path = Store(spark, "adjacency-file").path("lines")
    graph.write_adjacency(g_next(spark, sf), path, piece=20)
    return graph.read_adjacency(spark, path)


@query(
    "adjacency_lines",
    with_(
        edges_(SQL_NEXT),
        ("u", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst"),
        ("a", "SELECT src AS id, dst AS nbr FROM u UNION ALL SELECT dst, src FROM u"),
        ("ids", "SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM a)"),
        select="""SELECT 0::BIGINT AS line_no, (SELECT count(*) FROM ids) || ' ' || (SELECT count(*) FROM u) || ' 000' AS line
        UNION ALL SELECT i.n, string_agg(j.n::VARCHAR, ' ' ORDER BY j.n) FROM a JOIN ids i ON a.id = i.id
        JOIN ids j ON a.nbr = j.id GROUP BY i.n""",
    ),
)
def adjacency_lines(spark, sf):
    return graph.adjacency_lines(g_next(spark, sf))


# --- counts, degrees, simple graphs -------------------------------------------------


@query(
    "graph_counts",
    with_(edges_(SQL_TRADE), V, select="SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges"),
)
def graph_counts(spark, sf):
    return graph.graph_counts(g_trade(spark, sf))


@query("degree", with_(edges_(SQL_NEXT), DEG, select="SELECT id, degree FROM deg"))
def degree(spark, sf):
    return graph.degrees(g_next(spark, sf))


@query(
    "undirected_edges",
    with_(
        edges_(SQL_NEXT),
        select="SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst",
    ),
)
def undirected_edges(spark, sf):
    return graph.undirected(g_next(spark, sf))


@query(
    "unit_weight",
    with_(edges_(SQL_NEXT), select="SELECT src, dst, 1.0::DOUBLE AS weight FROM e WHERE src <> dst"),
)
def unit_weight(spark, sf):
    return graph.with_unit_weight(graph.drop_loops(g_next(spark, sf)))


@query("dense_ids", with_(edges_(SQL_TRADE), V, select="SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM v"))
def dense_ids(spark, sf):
    return graph.dense_ids(graph.vertices(g_trade(spark, sf)))


@query(
    "running_total",
    "SELECT o_orderkey, sum(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * o_custkey)"
    " OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM orders",
)
def running_total(spark, sf):
    signed = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    rows = table(spark, sf, "orders").select("o_orderkey", signed.alias("v"))
    return order.running_total(rows, ["o_orderkey"], "v").select("o_orderkey", "upto")


@query(
    "edge_sample",
    f"SELECT l_orderkey, l_linenumber, l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem"
    f" WHERE {sql_draw('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', salt=f'{SEED}:sample')} < 0.5",
)
def edge_sample(spark, sf):
    lines = table(spark, sf, "lineitem")
    kept = graph.edge_sample(lines, 0.5, SEED, key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return kept.select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")
    )


# --- joins --------------------------------------------------------------------------


@query(
    "triplets",
    with_(
        edges_(SQL_TRADE), V, LABELS,
        select="SELECT src, dst, a.label AS src_label, b.label AS dst_label FROM e"
        " JOIN labels0 a ON src = a.id JOIN labels0 b ON dst = b.id",
    ),
)
def triplets(spark, sf):
    e = g_trade(spark, sf)
    return graph.triplets(e, labels0(e), "label", find_hubs(e))


@query(
    "edge_cut",
    with_(
        edges_(SQL_TRADE), V, LABELS,
        select="SELECT count(*) FILTER (a.label <> b.label AND a.label <> 0 AND b.label <> 0) AS cut_real,"
        " count(*) FILTER (a.label <> b.label) AS cut_all"
        " FROM e JOIN labels0 a ON src = a.id JOIN labels0 b ON dst = b.id",
    ),
)
def edge_cut(spark, sf):
    e = g_trade(spark, sf)
    return route.edge_cut(graph.triplets(e, labels0(e), "label", find_hubs(e)))


@query(
    "cut_edges",
    with_(
        edges_(SQL_TRADE), V, LABELS,
        select="SELECT src, dst, a.label AS src_label, b.label AS dst_label FROM e"
        " JOIN labels0 a ON src = a.id JOIN labels0 b ON dst = b.id"
        " WHERE a.label <> b.label AND a.label <> 0 AND b.label <> 0",
    ),
)
def cut_edges(spark, sf):
    e = g_trade(spark, sf)
    return route.cut_edges(graph.triplets(e, labels0(e), "label", find_hubs(e)), ignore_core=True)


@query(
    "intra_part_edges",
    with_(
        edges_(SQL_TRADE), V, LABELS,
        select="SELECT a.label AS part, src, dst FROM e JOIN labels0 a ON src = a.id"
        " JOIN labels0 b ON dst = b.id WHERE a.label = b.label",
    ),
)
def intra_part_edges(spark, sf):
    e = g_trade(spark, sf)
    return graph.intra_part_edges(e, assignment0(e), find_hubs(e))


@query(
    "induced_subgraph",
    with_(
        edges_(SQL_TRADE), V, LABELS,
        select="SELECT src, dst FROM e JOIN labels0 a ON src = a.id JOIN labels0 b ON dst = b.id"
        " WHERE a.label > 1 AND b.label > 1",
    ),
)
def induced_subgraph(spark, sf):
    e = g_trade(spark, sf)
    return graph.induced(e, labels0(e).where("label > 1"), find_hubs(e))


@query(
    "missing_vertices",
    with_(edges_(SQL_TRADE), V, LABELS, GAP, select="SELECT id FROM v WHERE id NOT IN (SELECT id FROM gap)"),
)
def missing_vertices(spark, sf):
    e = g_trade(spark, sf)
    return route.missing_vertices(e, assignment_gap(e))


# --- iterative operators ------------------------------------------------------------


def sql_components(vertices: str, adjacency: str) -> tuple[str, str]:
    """A keyed recursive table: each round lowers the component of vertices that can improve."""
    return (
        "cc(id, comp) USING KEY (id)",
        f"""SELECT id, id FROM {vertices} UNION
        SELECT a.id, min(c.comp) FROM {adjacency} a JOIN cc c ON a.nbr = c.id
        JOIN recurring.cc r ON r.id = a.id WHERE c.comp < r.comp GROUP BY a.id""",
    )


def recursive(*ctes, select: str) -> str:
    body = ",\n".join(
        f"{name} AS ({sql})" if "USING KEY" in name else f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes
    )
    return f"WITH RECURSIVE {body}\n{select}"


@query(
    "components",
    recursive(edges_(SQL_GEO), V, ADJ, sql_components("v", "adj"), select="SELECT id, comp AS component FROM cc"),
)
def components(spark, sf):
    e = g_geo(spark, sf)
    return graph.components(graph.vertices(e), e)


@query(
    "components_chain",
    recursive(edges_(SQL_CHAT), V, ADJ, sql_components("v", "adj"), select="SELECT id, comp AS component FROM cc"),
)
def components_chain(spark, sf):
    e = g_chat(spark, sf)
    return graph.components(graph.vertices(e), e)


@query(
    "largest_component",
    recursive(
        edges_(SQL_GEO), V, ADJ, sql_components("v", "adj"),
        select="SELECT comp AS component, count(*) AS size FROM cc GROUP BY comp ORDER BY size DESC, comp LIMIT 1",
    ),
)
def largest_component(spark, sf):
    e = g_geo(spark, sf)
    return graph.largest_component(graph.components(graph.vertices(e), e))


@query(
    "components_by_part",
    recursive(
        edges_(SQL_GEO), V, LABELS,
        ("inner_adj", """SELECT src AS id, dst AS nbr FROM (SELECT src, dst FROM e JOIN labels0 a ON src = a.id JOIN labels0 b ON dst = b.id WHERE a.label = b.label)
        UNION ALL SELECT dst, src FROM (SELECT src, dst FROM e JOIN labels0 a ON src = a.id JOIN labels0 b ON dst = b.id WHERE a.label = b.label)"""),
        sql_components("v", "inner_adj"),
        select="SELECT label AS part, count(DISTINCT comp) AS n_components FROM cc JOIN labels0 USING (id) GROUP BY label",
    ),
)
def components_by_part(spark, sf):
    e = g_geo(spark, sf)
    return graph.components_by_part(e, assignment0(e))


def sql_pagerank(rounds: int) -> list[tuple[str, str]]:
    ctes = [
        ("outdeg", "SELECT src, count(*) AS n FROM e GROUP BY src"),
        ("r0", "SELECT id, 1.0::DOUBLE AS rank FROM v"),
    ]
    for i in range(1, rounds + 1):
        ctes.append(
            (
                f"r{i}",
                f"""SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(g.got, 0.0) AS rank FROM v LEFT JOIN
                (SELECT e.dst, sum(r.rank / o.n) AS got FROM e JOIN outdeg o ON e.src = o.src
                 JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst) g ON g.dst = v.id""",
            )
        )
    total = f"(SELECT count(*) / sum(rank) FROM r{rounds})"
    ctes.append(("pr", f"SELECT id, rank * {total} AS rank FROM r{rounds}"))
    return ctes


@query(
    "pagerank_10",
    with_(edges_(SQL_NEXT), V, *sql_pagerank(10), select=f"SELECT id, {sql_round('rank')} AS rank FROM pr"),
)
def pagerank_10(spark, sf):
    e = g_next(spark, sf)
    return graph.pagerank(e, tol=None, max_iter=10).select("id", rounded("rank").alias("rank"))


@query(
    "pagerank_basket",
    with_(edges_(SQL_BASKET), V, *sql_pagerank(5), select=f"SELECT id, {sql_round('rank')} AS rank FROM pr"),
)
def pagerank_basket(spark, sf):
    return graph.pagerank(g_basket(spark, sf), tol=None, max_iter=5).select("id", rounded("rank").alias("rank"))


@query("degree_basket", with_(edges_(SQL_BASKET), select="SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id"))
def degree_basket(spark, sf):
    return graph.degrees(g_basket(spark, sf))


@query(
    "pagerank_tol",
    """WITH RECURSIVE it(i, leaf, a, b, moved) AS (
      SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1e9::DOUBLE
      UNION ALL
      SELECT i + 1, 0.15::DOUBLE, na, nb, greatest(abs(na - a), abs(nb - b), abs(0.15::DOUBLE - leaf)) FROM (
        SELECT *, 0.15::DOUBLE + 0.85::DOUBLE * (leaf * (SELECT count(DISTINCT o_custkey) FROM orders) + b) AS na,
          0.15::DOUBLE + 0.85::DOUBLE * a AS nb FROM it WHERE moved > 1.0)),
    last AS (SELECT * FROM it ORDER BY i DESC LIMIT 1),
    ids AS (SELECT DISTINCT o_custkey + 10 AS id, 0 AS kind FROM orders UNION ALL VALUES (1, 1), (2, 2)),
    r AS (SELECT id::BIGINT AS id, CASE kind WHEN 0 THEN leaf WHEN 1 THEN a ELSE b END AS rank FROM ids, last)
    SELECT id, round(rank * (SELECT count(*) / sum(rank) FROM r), 6) + 0.0 AS rank FROM r""",
)
def pagerank_tol(spark, sf):
    """Customers point into a cycle of two, where ranks settle slowly: rounds are not limited."""
    leaf = table(spark, sf, "orders").select((F.col("o_custkey") + 10).cast("bigint").alias("src")).distinct()
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")
    e = leaf.withColumn("dst", F.lit(1).cast("bigint")).unionByName(cycle)
    return graph.pagerank(e, tol=1.0).select("id", rounded("rank").alias("rank"))


@query(
    "random_score",
    with_(edges_(SQL_TRADE), V, select=f"SELECT id, {sql_draw('id', salt=f'{SEED}:score')} AS score FROM v"),
)
def random_score(spark, sf):
    return graph.random_score(graph.vertices(g_trade(spark, sf)), SEED)


CORE_SIZE = 300


def sql_grow(size: int, rounds: int) -> list[tuple[str, str]]:
    u = sql_draw("id", salt=f"{SEED}:core")
    ctes = [("c0", f"SELECT id, 0 AS round FROM v ORDER BY {u}, id LIMIT 1")]
    for i in range(1, rounds + 1):
        ctes.append(
            (
                f"c{i}",
                f"""SELECT id, round FROM c{i - 1} UNION ALL
                SELECT id, {i} AS round FROM (SELECT id, row_number() OVER (ORDER BY {u}, id) AS n FROM
                  (SELECT DISTINCT a.nbr AS id FROM adj a JOIN c{i - 1} c ON c.id = a.id AND c.round = {i - 1}
                   WHERE a.nbr NOT IN (SELECT id FROM c{i - 1})))
                WHERE n <= {size} - (SELECT count(*) FROM c{i - 1})""",
            )
        )
    return ctes


@query("grow_core", with_(edges_(SQL_TRADE), V, ADJ, *sql_grow(CORE_SIZE, 6), select="SELECT id, round FROM c6"))
def grow_core(spark, sf):
    return graph.grow_core(g_trade(spark, sf), CORE_SIZE, SEED)


# --- diagnostics --------------------------------------------------------------------


@query(
    "top_scores",
    with_(edges_(SQL_TRADE), DEG, select="SELECT id, degree AS score FROM deg ORDER BY degree DESC, id LIMIT 20"),
)
def top_scores(spark, sf):
    return graph.top_scores(graph.degrees(g_trade(spark, sf)).withColumnRenamed("degree", "score"), 20)


@query(
    "top_degree",
    with_(
        ("e", f"SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({SQL_NEXT})"),
        DEG,
        select="SELECT id, degree, 10 / (SELECT count(*) FROM deg)::DOUBLE AS share FROM deg ORDER BY degree DESC, id LIMIT 10",
    ),
)
def top_degree(spark, sf):
    return graph.top_degree(g_next(spark, sf), 10)


SQL_STAGES = (
    "SELECT event_id AS remote_bytes_read, user_id AS result_size FROM events WHERE event_id % 3 = 0"
)


@query("stage_bytes", SQL_STAGES)
def stage_bytes(spark, sf):
    return sources.stage_bytes(event_log(spark, sf))


@query(
    "shuffle_bytes",
    f"""SELECT sum(remote_bytes_read)::BIGINT AS remote_bytes_read, sum(result_size)::BIGINT AS result_size,
    (sum(remote_bytes_read) + sum(result_size))::DOUBLE / 1e9::DOUBLE AS total_gb FROM ({SQL_STAGES})""",
)
def shuffle_bytes(spark, sf):
    return sources.shuffle_bytes(event_log(spark, sf))
