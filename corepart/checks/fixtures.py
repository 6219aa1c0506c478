"""Graphs, labels and embeddings derived from the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.functions import draw, draw_int
from corepart.operators import graph
from corepart.operators.skew import tasks_for

PARTS = 4
SEED = 7
SLACK = 1.05
CORE_RATE = 0.05
LAM_EDGE = 1.0
LAM_RANK = 0.5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- graphs -------------------------------------------------------------------------


def g_trade(spark, sf) -> DataFrame:
    """part → supplier, one edge per order line, duplicates kept."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")
    )


def g_next(spark, sf) -> DataFrame:
    """user → user of the following event."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    here = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("src"))
    return here.join(e.withColumnRenamed("user_id", "dst"), "event_id").select("src", "dst")


def g_basket(spark, sf) -> DataFrame:
    """part → part of the same order, each pair of numbers p < q once.

    There are as many tasks as the lines, and then the pairs, need: a task's memory does not grow with the tables.
    """
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
    lines = lines.repartition(tasks_for(spark, lines.count()), "l_orderkey").distinct()
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0  # pairs before the same ones are merged
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    pairs = a.join(b.hint("merge"), "l_orderkey").where("src < dst").select("src", "dst")
    return pairs.repartition(tasks_for(spark, most), "src", "dst").distinct()


def g_geo(spark, sf) -> DataFrame:
    """customer → nation, supplier → nation, nation → region: one component per region."""
    c = table(spark, sf, "customer").select(
        (F.col("c_custkey") * 4 + 2).alias("src"), (F.col("c_nationkey").cast("bigint") * 4 + 1).alias("dst")
    )
    s = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 4 + 3).alias("src"), (F.col("s_nationkey").cast("bigint") * 4 + 1).alias("dst")
    )
    n = table(spark, sf, "nation").select(
        (F.col("n_nationkey").cast("bigint") * 4 + 1).alias("src"),
        (F.col("n_regionkey").cast("bigint") * 4).alias("dst"),
    )
    return c.unionByName(s).unionByName(n)


def g_chat(spark, sf) -> DataFrame:
    """turn → next turn of the same conversation: one path per conversation."""
    t = table(spark, sf, "conversations").select("conv_id", "turn")
    here = t.select("conv_id", (F.col("turn") + 1).alias("turn"))
    to = F.col("conv_id") * 1000 + F.col("turn")
    return here.join(t, ["conv_id", "turn"]).select((to - 1).alias("src"), to.alias("dst"))


SQL_TRADE = "SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem"
SQL_BASKET = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"""
SQL_NEXT = (
    "SELECT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1"
)
SQL_GEO = (
    "SELECT c_custkey * 4 + 2 AS src, c_nationkey::BIGINT * 4 + 1 AS dst FROM customer"
    " UNION ALL SELECT s_suppkey * 4 + 3, s_nationkey::BIGINT * 4 + 1 FROM supplier"
    " UNION ALL SELECT n_nationkey::BIGINT * 4 + 1, n_regionkey::BIGINT * 4 FROM nation"
)
SQL_CHAT = (
    "SELECT b.conv_id * 1000 + b.turn - 1 AS src, b.conv_id * 1000 + b.turn AS dst"
    " FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
)


# --- SQL building blocks ------------------------------------------------------------


def sql_draw(*keys: str, salt: str) -> str:
    text = " || ':' || ".join([*(f"({k})::VARCHAR" for k in keys), f"'{salt}'"])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def sql_draw_int(*keys: str, salt: str, k: int, start: int = 0) -> str:
    return f"(floor({sql_draw(*keys, salt=salt)} * {k}) + {start})::INTEGER"


def sql_round(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0)"


def with_(*ctes: tuple[str, str], select: str, recursive: bool = False) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"


V = ("v", "SELECT src AS id FROM e UNION SELECT dst FROM e")
DEG = (
    "deg",
    "SELECT id, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id",
)
ADJ = ("adj", "SELECT src AS id, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e")
LABELS = ("labels0", f"SELECT id, {sql_draw_int('id', salt='labels', k=PARTS + 1)} AS label FROM v")
# a tenth of the vertices, chosen by draw, has no part
GAP = ("gap", f"SELECT id, label AS part FROM labels0 WHERE {sql_draw('id', salt='gap')} >= 0.1")
ASSIGN = ("asg", "SELECT id, label AS part FROM labels0")
STATE = ("state0", "SELECT id, label, degree::DOUBLE AS score FROM labels0 JOIN deg USING (id)")
ROUTED = (
    "routed",
    f"""SELECT p.part::INTEGER AS part, t.src, t.dst
    FROM (SELECT e.src, e.dst, coalesce(a.part, -1) AS a, coalesce(b.part, -1) AS b
          FROM e LEFT JOIN asg a ON e.src = a.id LEFT JOIN asg b ON e.dst = b.id) t
    JOIN (SELECT range AS part FROM range(1, {PARTS + 1})) p
    ON (t.a = 0 AND t.b = 0) OR (t.a > 0 AND t.b = 0 AND p.part = t.a)
       OR (t.a = 0 AND t.b > 0 AND p.part = t.b) OR (t.a > 0 AND t.a = t.b AND p.part = t.a)""",
)


def edges_(sql: str) -> tuple[str, str]:
    return ("e", sql)


# --- labels and states --------------------------------------------------------------


def labels0(edges: DataFrame) -> DataFrame:
    """A drawn label 0..P for every vertex."""
    return graph.vertices(edges).select("id", draw_int("id", salt="labels", k=PARTS + 1).alias("label"))


def assignment0(edges: DataFrame) -> DataFrame:
    return labels0(edges).withColumnRenamed("label", "part")


def assignment_gap(edges: DataFrame) -> DataFrame:
    return assignment0(edges).where(draw("id", salt="gap") >= 0.1)


def state0(edges: DataFrame) -> DataFrame:
    deg = graph.degrees(edges).select("id", F.col("degree").cast("double").alias("score"))
    return labels0(edges).join(deg, "id")


# --- lines --------------------------------------------------------------------------


def raw_lines(spark, sf) -> DataFrame:
    """One text line per event; some damaged in the ways a raw edge list can be."""
    n = F.col("event_id")
    a, b = F.col("user_id").cast("string"), F.concat(F.col("event_id").cast("string"), F.lit(".75"))
    line = (
        F.when(n % 19 == 0, F.concat(F.lit("# "), a, F.lit(" "), b))
        .when(n % 7 == 0, F.concat(a, F.lit(" "), b, F.lit(" 3")))
        .when(n % 11 == 0, F.concat(a, F.lit(" x"), b))
        .when(n % 13 == 0, F.concat(F.lit("  "), a, F.lit("   "), b, F.lit("\t")))
        .when(n % 17 == 0, F.concat(a, F.lit(" 1e3")))
        .when(n % 23 == 0, F.concat(a, F.lit("\t"), b))
        .when(n % 29 == 0, F.concat(a, F.lit(" NaN")))
        .otherwise(F.concat(a, F.lit(" -"), b))
    )
    return table(spark, sf, "events").select("event_id", line.alias("value"))


SQL_RAW = """SELECT event_id, CASE
  WHEN event_id % 19 = 0 THEN '# ' || user_id || ' ' || event_id || '.75'
  WHEN event_id % 7 = 0 THEN user_id || ' ' || event_id || '.75 3'
  WHEN event_id % 11 = 0 THEN user_id || ' x' || event_id || '.75'
  WHEN event_id % 13 = 0 THEN '  ' || user_id || '   ' || event_id || '.75' || chr(9)
  WHEN event_id % 17 = 0 THEN user_id || ' 1e3'
  WHEN event_id % 23 = 0 THEN user_id || chr(9) || event_id || '.75'
  WHEN event_id % 29 = 0 THEN user_id || ' NaN'
  ELSE user_id || ' -' || event_id || '.75' END AS value FROM events"""


def event_log(spark, sf) -> DataFrame:
    """One JSON line per event in the layout of a Spark event log; a third are completed stages."""
    kind = F.when(F.col("event_id") % 3 == 0, "SparkListenerStageCompleted").otherwise("SparkListenerTaskEnd")
    text = F.format_string(
        '{"Event":"%s","Metrics":[{"Name":"internal.metrics.shuffle.read.remoteBytesRead","Value":%d},'
        '{"Name":"internal.metrics.resultSize","Value":%d}]}',
        kind,
        "event_id",
        "user_id",
    )
    return table(spark, sf, "events").select(text.alias("value"))


# --- features and embeddings --------------------------------------------------------


def feat64(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("feat")
    )


def feat_map(spark, sf, edges: DataFrame) -> DataFrame:
    """A feature row for every vertex: the embedding at its id modulo the number of rows."""
    vecs = feat64(spark, sf)
    n = vecs.count()
    v = graph.vertices(edges).withColumn("slot", F.col("id") % n)
    return v.join(vecs.withColumnRenamed("id", "slot"), "slot").select("id", "feat")


SQL_FEAT = (
    "feat",
    "SELECT v.id, m.embedding AS feat FROM v JOIN embeddings m"
    " ON m.vec_id = v.id % (SELECT count(*) FROM embeddings)",
)


def part_emb(spark, sf) -> DataFrame:
    """Embeddings cut into parts 0..3 with a drawn core in every part.

    Part p > 0 holds the vectors rotated by p positions and scaled by p + 1, an invertible
    linear image, so aligning must give the original vectors back. Part 0 is the largest.
    """
    vecs = feat64(spark, sf)
    own = F.when(draw("id", salt="lean") < 0.25, 0).otherwise(draw_int("id", salt="part", k=PARTS))
    where = F.when(draw("id", salt="core") < 0.25, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(own))
    rows = vecs.select(F.explode(where).alias("part"), "id", "feat")
    d = F.size("feat")
    rotated = F.concat(F.slice("feat", F.col("part") + 1, d), F.slice("feat", F.lit(1), F.col("part")))
    return rows.select("part", "id", F.transform(rotated, lambda x: x * (F.col("part") + 1)).alias("vec"))


SQL_PART_EMB = (
    "pe",
    f"""SELECT p.part::INTEGER AS part, m.vec_id AS id,
      list_transform(list_concat(m.embedding[p.part + 1:], m.embedding[1:p.part]),
                     lambda x: x::DOUBLE * (p.part + 1)) AS vec
    FROM embeddings m JOIN (SELECT range AS part FROM range(0, {PARTS})) p
    ON {sql_draw('m.vec_id', salt='core')} < 0.25 OR p.part =
      CASE WHEN {sql_draw('m.vec_id', salt='lean')} < 0.25 THEN 0
           ELSE {sql_draw_int('m.vec_id', salt='part', k=PARTS)} END""",
)
