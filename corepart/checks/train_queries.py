"""Queries for training data, graph layers, training runs and alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corepart.checks.fixtures import *  # noqa: F403
from corepart.checks.registry import query, sql_values, values
from corepart.functions import rounded
from corepart.functions.draw import draw
from corepart.operators import align, route, sage, walks
from corepart.operators.skew import find_hubs
from corepart.plans import embed
from corepart.sources import parse_embeddings
from corepart.store import Store

NEXT_SET = ("es", "SELECT DISTINCT src, dst FROM e")
NEXT = [edges_(SQL_NEXT), V, NEXT_SET]


def routed_next(spark, sf):
    """Part edges 1..P of the user graph, with its core copied into every part."""
    e = g_next(spark, sf)
    return route.route_edges(e, assignment0(e), PARTS, find_hubs(e))


ROUTED_NEXT = [edges_(SQL_NEXT), V, LABELS, ASSIGN, ROUTED, ("pe1", "SELECT DISTINCT part, src, dst FROM routed")]
PART_V = ("pv", "SELECT part, src AS id FROM pe1 UNION SELECT part, dst FROM pe1")

# --- part graphs --------------------------------------------------------------------


@query(
    "part_graph",
    with_(
        *ROUTED_NEXT, PART_V,
        ("ix", "SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS idx FROM pv"),
        select="SELECT p.part, src, dst, a.idx AS src_idx, b.idx AS dst_idx FROM pe1 p"
        " JOIN ix a ON a.part = p.part AND a.id = src JOIN ix b ON b.part = p.part AND b.id = dst",
    ),
)
def part_graph(spark, sf):
    return walks.part_graph(routed_next(spark, sf))[0]


@query(
    "part_graph_feats",
    with_(
        *ROUTED_NEXT, PART_V, SQL_FEAT,
        ("pf", "SELECT part, id, feat FROM pv JOIN feat USING (id)"),
        select=sql_values("pf", "part, id", "feat"),
    ),
)
def part_graph_feats(spark, sf):
    v = walks.part_graph(routed_next(spark, sf))[1]
    return values(walks.part_graph_feats(v, feat_map(spark, sf, g_next(spark, sf))), ["part", "id"], "feat")


# --- walks and pairs ----------------------------------------------------------------

LENGTH, PER_NODE = 4, 2


def sql_walks(keys: str, edges: str, verts: str) -> list[tuple[str, str]]:
    """w0 .. w3: walks after each step; `keys` are the part columns, `` when there is one graph."""
    k = [c.strip() for c in keys.split(",") if c.strip()]
    cols = "".join(f"{c}, " for c in k)
    on = "".join(f" AND x.{c} = w.{c}" for c in k)
    ctes = [
        ("nb", f"SELECT {cols}src, dst, row_number() OVER (PARTITION BY {cols}src ORDER BY dst) - 1 AS rk,"
               f" count(*) OVER (PARTITION BY {cols}src) AS deg FROM {edges}"),
        ("od", f"SELECT DISTINCT {cols}src, deg FROM nb"),
        ("w0", f"SELECT {cols}id AS origin, r.walk::INTEGER AS walk, id AS s0 FROM {verts}, (SELECT range AS walk FROM range({PER_NODE})) r"),
    ]
    wcols = "".join(f"w.{c}, " for c in k)
    for i in range(1, LENGTH):
        u = sql_draw(*[f"w.{c}" for c in k], "w.origin", "w.walk", salt=f"{SEED}:walk:{i}")
        keep = ", ".join(f"w.s{j}" for j in range(i))
        ctes.append((f"p{i}", f"SELECT w.*, floor({u} * x.deg) AS pick FROM w{i - 1} w LEFT JOIN od x ON x.src = w.s{i - 1}{on}"))
        ctes.append((
            f"w{i}",
            f"SELECT {wcols}w.origin, w.walk, {keep}, coalesce(x.dst, w.s{i - 1}) AS s{i} FROM p{i} w"
            f" LEFT JOIN nb x ON x.src = w.s{i - 1} AND x.rk = w.pick{on}",
        ))
    return ctes


WALKS = [*NEXT, *sql_walks("", "es", "v")]


def _steps(w, keys):
    return w.select(*keys, *[F.get("path", F.lit(i)).alias(f"s{i}") for i in range(LENGTH)])


@query("random_walks", with_(*WALKS, select="SELECT origin, walk, s0, s1, s2, s3 FROM w3"))
def random_walks(spark, sf):
    return _steps(walks.random_walks(g_next(spark, sf), LENGTH, PER_NODE, SEED), ["origin", "walk"])


@query(
    "random_walks_by_part",
    with_(*ROUTED_NEXT, PART_V, *sql_walks("part", "pe1", "pv"), select="SELECT part, origin, walk, s0, s1, s2, s3 FROM w3"),
)
def random_walks_by_part(spark, sf):
    w = walks.random_walks(routed_next(spark, sf), LENGTH, PER_NODE, SEED, by=("part",))
    return _steps(w, ["part", "origin", "walk"])


def sql_biased(p: float, q: float, tries: int) -> list[tuple[str, str]]:
    """Steps 2 and 3 with numbered tries; `tries` is far beyond what any walker needs."""
    top = max(1 / p, 1.0, 1 / q)
    ctes = [*sql_walks("", "es", "v")[:5]]
    for i in range(2, LENGTH):
        u = sql_draw("w.origin", "w.walk", "r.try", salt=f"{SEED}:walk:{i}")
        ok = sql_draw("t.origin", "t.walk", "t.try", salt=f"{SEED}:accept:{i}")
        keep = ", ".join(f"t.s{j}" for j in range(i))
        ctes += [
            (f"t{i}", f"""SELECT w.*, r.try, x.dst AS cand FROM w{i - 1} w, (SELECT range AS try FROM range({tries})) r
              LEFT JOIN od ON od.src = w.s{i - 1}
              LEFT JOIN nb x ON x.src = w.s{i - 1} AND x.rk = floor({u} * od.deg)"""),
            (f"w{i}", f"""SELECT t.origin, t.walk, {keep}, coalesce(t.cand, t.s{i - 1}) AS s{i} FROM t{i} t
              LEFT JOIN es ON es.src = t.s{i - 2} AND es.dst = t.cand
              WHERE t.cand IS NULL OR {ok} < (CASE WHEN t.cand = t.s{i - 2} THEN {1 / p}::DOUBLE
                WHEN es.src IS NOT NULL THEN 1.0::DOUBLE ELSE {1 / q}::DOUBLE END) / {top}::DOUBLE
              QUALIFY row_number() OVER (PARTITION BY t.origin, t.walk ORDER BY t.try) = 1"""),
        ]
    return ctes


@query("biased_walks", with_(*NEXT, *sql_biased(0.5, 2.0, 200), select="SELECT origin, walk, s0, s1, s2, s3 FROM w3"))
def biased_walks(spark, sf):
    w = walks.random_walks(g_next(spark, sf), LENGTH, PER_NODE, SEED, p=0.5, q=2.0)
    return _steps(w, ["origin", "walk"])


@query(
    "walk_pairs",
    with_(
        *WALKS,
        select=" UNION ALL ".join(
            f"SELECT origin, walk, {j} AS j, {i} AS i, s{j} AS src, s{j + i} AS dst FROM w3"
            for j in range(LENGTH - 2) for i in (1, 2) if j + i < LENGTH and j <= LENGTH - 3
        ),
    ),
)
def walk_pairs(spark, sf):
    w = walks.random_walks(g_next(spark, sf), LENGTH, PER_NODE, SEED)
    return walks.walk_pairs(w, context=3)


# --- negative samples ---------------------------------------------------------------

WEIGHTS = ("wt", "SELECT dst AS id, count(*) AS in_degree, pow(count(*), 0.75) AS weight FROM es GROUP BY dst")
LINE = (
    "line",
    """SELECT id, w, sum(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto
    FROM (SELECT id, round(weight * 1000000)::BIGINT AS w FROM wt)""",
)
K = 3


def sql_negatives(ids: list[str], source: str) -> list[tuple[str, str]]:
    u = sql_draw(*ids, "neg", salt=f"{SEED}:negative")
    return [
        WEIGHTS, LINE,
        ("dr", f"SELECT src, dst, neg, floor({u} * (SELECT max(upto) FROM line))::BIGINT AS t FROM {source},"
               f" (SELECT range::INTEGER AS neg FROM range({K})) r"),
        ("ng", "SELECT src, dst, neg, id AS neg_dst FROM dr JOIN line ON t >= upto - w AND t < upto"),
    ]


@query("neg_weights", with_(*NEXT, WEIGHTS, select=f"SELECT id, in_degree, {sql_round('weight')} AS weight FROM wt"))
def neg_weights(spark, sf):
    return walks.neg_weights(g_next(spark, sf)).withColumn("weight", rounded("weight"))


@query("negative_pairs", with_(*NEXT, *sql_negatives(["src", "dst"], "es"), select="SELECT src, dst, neg, neg_dst FROM ng"))
def negative_pairs(spark, sf):
    e = g_next(spark, sf)
    return walks.negative_pairs(e.distinct(), e, K, SEED)


@query(
    "negative_pairs_shared",
    with_(
        *NEXT,
        ("sh", f"""SELECT src, dst, range AS copy, ((row_number() OVER (ORDER BY src, dst, range) - 1) // {K})::VARCHAR AS grp
          FROM es, range({K})"""),
        WEIGHTS, LINE,
        ("dr", f"""SELECT src, dst, copy, neg, floor({sql_draw('grp', 'neg', salt=f'{SEED}:negative')} * (SELECT max(upto) FROM line))::BIGINT AS t
          FROM sh, (SELECT range::INTEGER AS neg FROM range({K})) r"""),
        select="SELECT src, dst, copy::INTEGER AS copy, neg, id AS neg_dst FROM dr JOIN line ON t >= upto - w AND t < upto",
    ),
)
def negative_pairs_shared(spark, sf):
    """K copies of every pair: their number is divisible by K, so K pairs share K targets."""
    e = g_next(spark, sf)
    copies = e.distinct().withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
    return walks.negative_pairs(copies, e, K, SEED, share=True, key=("src", "dst", "copy"))


@query(
    "negative_pairs_shared_by_part",
    with_(
        *NEXT,
        ("pe", "SELECT src % 2 AS part, src, dst FROM es"),
        ("pairs", f"SELECT part, src, dst, range AS copy FROM pe, range({K}) WHERE part = 0 OR range = 0"),
        ("sh", f"""SELECT *, CASE WHEN count(*) OVER (PARTITION BY part) % {K} = 0
          THEN part || ':' || ((row_number() OVER (PARTITION BY part ORDER BY src, dst, copy) - 1) // {K})
          ELSE part || ':' || src || ':' || dst || ':' || copy END AS grp FROM pairs"""),
        ("pw", """SELECT part, dst AS id, round(pow(count(*), 0.75) * 1000000)::BIGINT AS w FROM pe GROUP BY part, dst"""),
        ("line", "SELECT part, id, w, sum(w) OVER (PARTITION BY part ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto FROM pw"),
        ("top", "SELECT part, max(upto) AS span FROM line GROUP BY part"),
        ("dr", f"""SELECT part, src, dst, copy, neg, floor({sql_draw('grp', 'neg', salt=f'{SEED}:negative')} * span)::BIGINT AS t
          FROM sh JOIN top USING (part), (SELECT range::INTEGER AS neg FROM range({K})) r"""),
        select="""SELECT d.part::BIGINT AS part, src, dst, copy::INTEGER AS copy, neg, id AS neg_dst
          FROM dr d JOIN line l ON d.part = l.part AND t >= upto - w AND t < upto""",
    ),
)
def negative_pairs_shared_by_part(spark, sf):
    """Part 0 has K copies of its pairs and shares; part 1 shares only if its own count allows it."""
    e = g_next(spark, sf).withColumn("part", F.col("src") % 2)
    copies = F.sequence(F.lit(0), F.when(F.col("part") == 0, F.lit(K - 1)).otherwise(F.lit(0)))
    pairs = e.distinct().withColumn("copy", F.explode(copies))
    return walks.negative_pairs(pairs, e, K, SEED, share=True, key=("src", "dst", "copy"), by=("part",))


# --- neighbours and layers ----------------------------------------------------------


def sql_layer_sample(layer: int, fanout: int, seeds: str) -> str:
    u = sql_draw("src", "dst", salt=f"{SEED}:layer:{layer}")
    return (
        f"SELECT {layer} AS layer, dst, src FROM es WHERE dst IN (SELECT id FROM {seeds})"
        f" QUALIFY row_number() OVER (PARTITION BY dst ORDER BY {u}, src) <= {fanout}"
    )


@query(
    "sample_neighbors",
    with_(
        edges_(SQL_TRADE), NEXT_SET, ("seeds", "SELECT l_suppkey * 2 + 1 AS id FROM lineitem"),
        ("l0", sql_layer_sample(0, 10, "seeds")),
        ("f1", "SELECT id FROM seeds UNION SELECT src FROM l0"),
        ("l1", sql_layer_sample(1, 5, "f1")),
        select="SELECT layer, dst, src FROM l0 UNION ALL SELECT layer, dst, src FROM l1",
    ),
)
def sample_neighbors(spark, sf):
    e = g_trade(spark, sf)
    return walks.sample_neighbors(e.select(F.col("dst").alias("id")), e, (5, 10), SEED)


def _weights(n_in: int, n_out: int) -> sage.Layer:
    """Small fixed weights that SQL can compute as well."""
    i, j = np.indices((n_in, n_out))
    return sage.Layer(((i * 7 + j * 3) % 11 - 5) / 10.0, ((i * 5 + j * 2) % 13 - 6) / 10.0, (np.arange(n_out) - 1) / 4.0)


def sql_sage_layer(name: str, h: str, n_out: int, relu: bool) -> list[tuple[str, str]]:
    """`h` and the result are (id, i, x) with one row per value."""
    out = "greatest(z, 0.0)" if relu else "z"
    return [
        (f"{name}_m", f"SELECT es.dst AS id, h.i, avg(h.x) AS m FROM es JOIN {h} h ON h.id = es.src GROUP BY es.dst, h.i"),
        (f"{name}_z", f"""SELECT h.id, j.j AS i, sum(h.x * (((h.i * 7 + j.j * 3) % 11 - 5) / 10.0::DOUBLE)
            + coalesce(m.m, 0.0) * (((h.i * 5 + j.j * 2) % 13 - 6) / 10.0::DOUBLE)) + any_value((j.j - 1) / 4.0::DOUBLE) AS z
          FROM {h} h LEFT JOIN {name}_m m ON m.id = h.id AND m.i = h.i, (SELECT range AS j FROM range({n_out})) j
          GROUP BY h.id, j.j"""),
        (name, f"SELECT id, i, {out} AS x FROM {name}_z"),
    ]


SAGE_IN = [*NEXT, SQL_FEAT, ("h0", "SELECT id, generate_subscripts(feat, 1) - 1 AS i, unnest(feat)::DOUBLE AS x FROM feat")]


@query(
    "sage_layer",
    with_(*SAGE_IN, *sql_sage_layer("h1", "h0", 8, True), select=f"SELECT id, i::INTEGER AS pos, {sql_round('x')} AS val FROM h1"),
)
def sage_layer(spark, sf):
    e = g_next(spark, sf).distinct()
    out = sage.sage_layer(feat_map(spark, sf, e), e, _weights(64, 8), relu=True, hubs=find_hubs(e))
    return values(out, ["id"], "feat")


@query(
    "sage_infer",
    with_(
        *SAGE_IN, *sql_sage_layer("h1", "h0", 8, True), *sql_sage_layer("h2", "h1", 4, False),
        select=f"SELECT id, i::INTEGER AS pos, {sql_round('x')} AS val FROM h2",
    ),
)
def sage_infer(spark, sf):
    e = g_next(spark, sf).distinct()
    out = sage.sage_infer(feat_map(spark, sf, e), e, [_weights(64, 8), _weights(8, 4)], hubs=find_hubs(e))
    return values(out, ["id"], "feat")


DOT = "list_dot_product(a.feat::DOUBLE[], b.feat::DOUBLE[])"


@query(
    "edge_scores",
    with_(
        edges_(SQL_NEXT), NEXT_SET,
        ("x", "SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"),
        ("n", "SELECT count(*) AS n FROM embeddings"),
        ("ends", "SELECT src, dst, src % n AS a, dst % n AS b FROM es, n"),
        ("sc", "SELECT src, dst, sum(p.x * q.x) AS z FROM ends JOIN x p ON p.vec_id = a JOIN x q ON q.vec_id = b AND q.i = p.i GROUP BY src, dst"),
        select=f"SELECT e.src, e.dst, {sql_round('z')} AS score FROM e JOIN sc ON e.src = sc.src AND e.dst = sc.dst",
    ),
)
def edge_scores(spark, sf):
    e = g_next(spark, sf)
    return sage.edge_scores(e, feat_map(spark, sf, e), find_hubs(e)).withColumn("score", rounded("score"))


@query(
    "link_loss",
    with_(
        *NEXT, SQL_FEAT, *sql_negatives(["src", "dst"], "es"),
        ("sc", f"""SELECT {DOT} AS x, 1.0::DOUBLE AS y FROM es JOIN feat a ON a.id = src JOIN feat b ON b.id = dst
          UNION ALL SELECT {DOT}, 0.0 FROM ng JOIN feat a ON a.id = src JOIN feat b ON b.id = neg_dst"""),
        select=f"SELECT {sql_round('avg(greatest(x, 0.0) - x * y + ln(1.0 + exp(-abs(x))))')} AS loss FROM sc",
    ),
)
def link_loss(spark, sf):
    e = g_next(spark, sf).distinct()
    feats, hubs = feat_map(spark, sf, e), find_hubs(e)
    neg = walks.negative_pairs(e, e, K, SEED).select("src", F.col("neg_dst").alias("dst"))
    loss = sage.link_loss(sage.edge_scores(e, feats, hubs), sage.edge_scores(neg, feats, hubs))
    return loss.select(rounded("loss").alias("loss"))


# --- training runs ------------------------------------------------------------------

DIM = 16
TRAIN = {"dim": DIM, "seed": SEED, "batch_size": 2000}


def _shape(emb):
    """(part, id, dim, finite): what a training run must give for every vertex of every part."""
    ok = F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))
    return emb.select("part", "id", F.size("vec").alias("dim"), ok.alias("finite"))


SQL_SHAPE = f"SELECT part, id, {DIM} AS dim, true AS finite FROM pv"


@query("embed_walks", with_(*ROUTED_NEXT, PART_V, select=SQL_SHAPE))
def embed_walks(spark, sf):
    return _shape(embed.embed_parts(routed_next(spark, sf), "walks", **TRAIN))


PLACES = ("pl", "SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS place FROM pv")
UNIFORM = (
    "un",
    f"""SELECT p.part, src, dst, id AS neg_dst FROM pe1 p JOIN (SELECT part, count(*) AS n FROM pv GROUP BY part) c USING (part)
    JOIN pl ON pl.part = p.part
      AND place = floor({sql_draw('p.part', 'src', 'dst', '0', salt=f'{SEED}:negative')} * n * 1000000)::BIGINT // 1000000""",
)


@query("walk_negatives", with_(*ROUTED_NEXT, PART_V, PLACES, UNIFORM, select="SELECT part, src, dst, neg_dst FROM un"))
def walk_negatives(spark, sf):
    """One target for each pair, drawn from all vertices of its part alike."""
    e = walks.part_edges_clean(routed_next(spark, sf))
    return walks.negative_pairs(e, e, 1, SEED, by=("part",), uniform=True).drop("neg")


@query(
    "skip_gram_step",
    with_(
        *ROUTED_NEXT, PART_V, PLACES, UNIFORM,
        ("x0", f"""SELECT part, id, i, {sql_draw('part', '0', 'id', 'i', salt=f'{SEED}:start')} - 0.5::DOUBLE AS x
          FROM pv, (SELECT range AS i FROM range(4)) r"""),
        ("rw", """SELECT *, row_number() OVER () AS rid FROM
          (SELECT part, src, dst, 1.0::DOUBLE AS y FROM pe1 UNION ALL SELECT part, src, neg_dst, 0.0::DOUBLE FROM un)"""),
        ("gs", """SELECT rid, 1 / (1 + exp(-sum(a.x * c.x))) - any_value(y) AS g FROM rw
          JOIN x0 a ON a.part = rw.part AND a.id = src JOIN x0 c ON c.part = rw.part AND c.id = dst AND c.i = a.i GROUP BY rid"""),
        ("gd", """SELECT part, id, i, sum(d) / (SELECT count(*) FROM pe1 WHERE pe1.part = u.part) AS g FROM (
          SELECT rw.part, src AS id, c.i, g * c.x AS d FROM rw JOIN gs USING (rid) JOIN x0 c ON c.part = rw.part AND c.id = dst
          UNION ALL
          SELECT rw.part, dst, a.i, g * a.x FROM rw JOIN gs USING (rid) JOIN x0 a ON a.part = rw.part AND a.id = src) u
          GROUP BY part, id, i"""),
        select=f"""SELECT part, id, i::INTEGER AS pos, {sql_round('x - 0.01::DOUBLE * g / (abs(g) + 1e-8::DOUBLE)')} AS val
          FROM x0 JOIN gd USING (part, id, i)""",
    ),
)
def skip_gram_step(spark, sf):
    """One step over all pairs of every part, from start values that SQL can repeat."""
    e = walks.part_edges_clean(routed_next(spark, sf))
    pairs = e.select("part", F.concat_ws(":", "src", "dst").alias("pair"), "src", "dst")
    start = F.array(*(draw("part", "role", "id", F.lit(i), salt=f"{SEED}:start") - F.lit(0.5) for i in range(4)))
    out = embed.skip_gram(pairs, e, dim=4, batch_size=10**9, seed=SEED, uniform=True, start=start)
    return values(out, ["part", "id"], "vec")


BASKET = ("bk", SQL_BASKET)


@query(
    "embed_learns",
    with_(BASKET, select="SELECT 1 AS part, count(*) AS n_pairs, true AS learned FROM bk"),
)
def embed_learns(spark, sf):
    """Skip-gram on all pairs of the basket graph, in steps of the given batch size: pairs score above drawn ones.

    Four buckets of vertices rotate; `learned` asks for a true pair to beat a drawn one in 55 of 100 cases: baskets are nearly random.
    """
    store = Store(spark, "embed-learns")
    e = store.save(g_basket(spark, sf).withColumn("part", F.lit(1)), "pairs")
    pairs = e.select("part", F.concat_ws(":", "src", "dst").alias("pair"), "src", "dst")
    n = e.select(F.explode(F.array("src", "dst"))).distinct().count()
    size = -(-n // 4) * DIM * 8 * 3
    options = {"dim": DIM, "lr": 0.05, "epochs": 3, "batch_size": 200, "seed": SEED, "init_scale": 0.3, "bucket_bytes": size}
    emb = store.save(embed.skip_gram(pairs, e, **options), "vectors").select("id", F.col("vec").alias("feat"))
    # A pair is its two ends: keyed by them, draws need not be joined back, and scores travel along.
    drawn = walks.negative_pairs(pairs, e, 1, SEED + 99, by=("part",), uniform=True)
    both = drawn.select("src", "dst", F.col("neg_dst").alias("other")).where(F.col("other") != F.col("src"))
    hubs = find_hubs(e)
    true = sage.edge_scores(both, emb, hubs, keep=("other",)).withColumnRenamed("dst", "true").withColumnsRenamed({"other": "dst", "score": "high"})
    judged = sage.edge_scores(true, emb, hubs, keep=("high",))
    won = judged.agg(F.avg((F.col("high") > F.col("score")).cast("double"))).first()[0]
    return e.groupBy("part").agg(F.count(F.lit(1)).alias("n_pairs")).withColumn("learned", F.lit(won > 0.55))


D_IN, D_HID = 4, 3  # of the step that SQL repeats


def sql_sampled(name: str, number: int, fanout: int) -> tuple[str, str]:
    u = sql_draw("part", "src", "dst", salt=f"{SEED}:block:0:{number}")
    return (name, f"SELECT part, src, dst FROM pe1 QUALIFY row_number() OVER (PARTITION BY part, dst ORDER BY {u}, src) <= {fanout}")


def sql_weight(i: str, j: str, which: str) -> str:
    return {"self": f"((({i}) * 7 + ({j}) * 3) % 11 - 5) / 10.0::DOUBLE", "neigh": f"((({i}) * 5 + ({j}) * 2) % 13 - 6) / 10.0::DOUBLE"}[which]


STEP_NEG = sql_draw("part", "src || ':' || dst", "0", salt=f"{SEED}:negative")
SAGE_STEP = [
    *ROUTED_NEXT, PART_V, SQL_FEAT,
    ("f4", f"SELECT part, id, r.range AS i, feat[r.range + 1]::DOUBLE AS x FROM pv JOIN feat USING (id), range({D_IN}) r"),
    sql_sampled("inner5", 0, 5), sql_sampled("outer10", 1, 10),
    ("mn", "SELECT s.part, s.dst AS id, f.i, avg(f.x) AS m FROM inner5 s JOIN f4 f ON f.part = s.part AND f.id = s.src GROUP BY ALL"),
    ("own", f"""SELECT part, id, i, x::FLOAT::DOUBLE AS x FROM f4
      UNION ALL SELECT part, id, i + {D_IN}, coalesce(m, 0.0)::FLOAT::DOUBLE FROM f4 LEFT JOIN mn USING (part, id, i)"""),
    ("h", f"""SELECT part, id, j.range AS a, greatest(sum(x * CASE WHEN i < {D_IN} THEN {sql_weight('i', 'j.range', 'self')}
      ELSE {sql_weight(f'i - {D_IN}', 'j.range', 'neigh')} END) + (j.range - 1) / 4.0::DOUBLE, 0.0) AS x FROM own, range({D_HID}) j GROUP BY part, id, j.range"""),
    ("mh", "SELECT s.part, s.dst AS id, a, avg(h.x) AS m FROM outer10 s JOIN h ON h.part = s.part AND h.id = s.src GROUP BY ALL"),
    ("hm", "SELECT part, id, a, x, coalesce(m, 0.0) AS m FROM h LEFT JOIN mh USING (part, id, a)"),
    ("o", f"""SELECT part, id, b.range AS b, sum(x * {sql_weight('a', 'b.range', 'self')} + m * {sql_weight('a', 'b.range', 'neigh')})
      + (b.range - 1) / 4.0::DOUBLE AS y FROM hm, range({D_HID}) b GROUP BY part, id, b.range"""),
    ("pw", "SELECT part, dst AS id, round(pow(count(*), 0.75) * 1000000)::BIGINT AS w FROM pe1 GROUP BY part, dst"),
    ("wl", "SELECT part, id, w, sum(w) OVER (PARTITION BY part ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY part) AS span FROM pw"),
    ("tr", f"SELECT p.part, src, dst, id AS neg FROM pe1 p JOIN wl ON wl.part = p.part AND floor({STEP_NEG.replace('part', 'p.part')} * span)::BIGINT BETWEEN upto - w AND upto - 1"),
    ("sc", """SELECT t.part, t.src, t.dst, t.neg, sum(s.y * p.y) AS sp, sum(s.y * n.y) AS sn FROM tr t JOIN o s ON s.part = t.part AND s.id = t.src
      JOIN o p ON p.part = t.part AND p.id = t.dst AND p.b = s.b JOIN o n ON n.part = t.part AND n.id = t.neg AND n.b = s.b GROUP BY ALL"""),
    ("gs", "SELECT *, 1 / (1 + exp(-sp)) - 1 AS gp, 1 / (1 + exp(-sn)) AS gn FROM sc"),
    ("go", """SELECT part, id, b, sum(g) AS g FROM (
      SELECT g.part, src AS id, p.b, gp * p.y + gn * n.y AS g FROM gs g JOIN o p ON p.part = g.part AND p.id = dst JOIN o n ON n.part = g.part AND n.id = neg AND n.b = p.b
      UNION ALL SELECT g.part, dst, s.b, gp * s.y FROM gs g JOIN o s ON s.part = g.part AND s.id = src
      UNION ALL SELECT g.part, neg, s.b, gn * s.y FROM gs g JOIN o s ON s.part = g.part AND s.id = src) GROUP BY ALL"""),
    ("np", "SELECT part, count(*) AS n FROM tr GROUP BY part"),
    ("gw", f"""SELECT part, 'self' AS name, (a * {D_HID} + b)::INTEGER AS pos, {sql_weight('a', 'b', 'self')} AS w, sum(x * g) AS g FROM hm JOIN go USING (part, id) GROUP BY part, a, b
      UNION ALL SELECT part, 'neigh', (a * {D_HID} + b)::INTEGER, {sql_weight('a', 'b', 'neigh')}, sum(m * g) FROM hm JOIN go USING (part, id) GROUP BY part, a, b
      UNION ALL SELECT part, 'bias', b::INTEGER, (b - 1) / 4.0::DOUBLE, sum(g) FROM go GROUP BY part, b"""),
]


@query(
    "sage_step",
    with_(
        *SAGE_STEP,
        select=f"""SELECT part, name, pos, {sql_round('w - 0.01::DOUBLE * (g / (2 * n)) / (abs(g / (2 * n)) + 1e-8::DOUBLE)')} AS val FROM gw JOIN np USING (part)
        UNION ALL SELECT part, 'loss', 0, {sql_round('sum(ln(1 + exp(-sp)) + ln(1 + exp(sn))) / (2 * count(*))')} FROM gs GROUP BY part""",
    ),
)
def sage_step(spark, sf):
    """One step of the graph layers over all pairs of every part, from weights that SQL can repeat: the loss
    before it and the second layer after it."""
    edges = Store(spark, "sage-step").save(walks.part_edges_clean(routed_next(spark, sf)), "edges")
    feats = feat_map(spark, sf, g_next(spark, sf)).withColumn("feat", F.slice("feat", 1, D_IN))
    feats = walks.part_graph_feats(walks.part_vertices(edges), feats)
    pairs = edges.select("part", F.concat_ws(":", "src", "dst").alias("pair"), "src", "dst")
    start = [_weights(D_IN, D_HID), _weights(D_HID, D_HID)]
    flat = np.concatenate([x.ravel() for layer in start for x in (layer.w_self, layer.w_neigh, layer.bias)])
    layers, losses = embed.train_sage(pairs, edges, feats, hidden=D_HID, dropout=0.0, batch_size=10**9, seed=SEED, start=flat)
    rows = [(h["part"], "loss", 0, float(h["loss"])) for h in losses]
    for part, (_, second) in layers.items():  # a few weights per part
        for name, table in (("self", second.w_self), ("neigh", second.w_neigh), ("bias", second.bias)):
            rows += [(part, name, i, float(x)) for i, x in enumerate(np.ravel(table))]
    out = spark.createDataFrame(rows, "part int, name string, pos int, val double")
    return out.withColumn("val", rounded("val"))


LINES = ("ln", "SELECT part, src, dst, row_number() OVER (PARTITION BY part, src, dst) AS line FROM routed")
KEPT = ("kept", f"SELECT part, src, dst FROM ln WHERE {sql_draw('part', 'src', 'dst', 'line', salt=f'{SEED}:sample')} < 0.5")


@query(
    "edge_sentences",
    with_(
        *ROUTED_NEXT, LINES, KEPT,
        ("both_ways", "SELECT part, src, dst FROM kept UNION ALL SELECT part, dst, src FROM kept"),
        select="SELECT part, src, dst, count(*) AS n FROM both_ways GROUP BY ALL",
    ),
)
def edge_sentences(spark, sf):
    rows = embed.edge_sentences(routed_next(spark, sf), SEED)
    return rows.groupBy("part", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("embed_edges", with_(*ROUTED_NEXT[:-1], LINES, KEPT, ("pe1", "SELECT DISTINCT part, src, dst FROM kept"), PART_V, select=SQL_SHAPE))
def embed_edges(spark, sf):
    return _shape(embed.embed_parts(routed_next(spark, sf), "edges", **TRAIN))


@query("embed_sage", with_(*ROUTED_NEXT, PART_V, select=SQL_SHAPE))
def embed_sage(spark, sf):
    feats = feat_map(spark, sf, g_next(spark, sf))
    return _shape(embed.embed_parts(routed_next(spark, sf), "sage", feats, **TRAIN))


@query("embed_sage_walks", with_(*ROUTED_NEXT, PART_V, select=SQL_SHAPE))
def embed_sage_walks(spark, sf):
    feats = feat_map(spark, sf, g_next(spark, sf))
    return _shape(embed.embed_parts(routed_next(spark, sf), "sage_walks", feats, **TRAIN))


@query("embed_resume", with_(*ROUTED_NEXT, PART_V, select="SELECT part, id, true AS same FROM pv"))
def embed_resume(spark, sf):
    """A run stopped after its first epoch and continued equals a run without a stop."""
    edges = Store(spark, "resume").save(routed_next(spark, sf), "edges")
    path = Store(spark, "resume-state").root
    embed.embed_parts(edges, "walks", state_path=path, epochs=1, **TRAIN)
    continued = embed.embed_parts(edges, "walks", state_path=path, epochs=2, **TRAIN)
    whole = embed.embed_parts(edges, "walks", epochs=2, **TRAIN)
    both = continued.join(whole.withColumnRenamed("vec", "other"), ["part", "id"])
    same = F.forall(F.zip_with("vec", "other", lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return both.select("part", "id", same.alias("same"))


@query("embed_resume_sage", with_(*ROUTED_NEXT, PART_V, select="SELECT part, id, true AS same FROM pv"))
def embed_resume_sage(spark, sf):
    """The same for the graph layers: weights, moments and step counts continue where they stopped."""
    edges = Store(spark, "resume-sage").save(routed_next(spark, sf), "edges")
    feats = feat_map(spark, sf, g_next(spark, sf))
    path = Store(spark, "resume-sage-state").root
    embed.embed_parts(edges, "sage", feats, state_path=path, epochs=1, **TRAIN)
    continued = embed.embed_parts(edges, "sage", feats, state_path=path, epochs=2, **TRAIN)
    whole = embed.embed_parts(edges, "sage", feats, epochs=2, **TRAIN)
    both = continued.join(whole.withColumnRenamed("vec", "other"), ["part", "id"])
    same = F.forall(F.zip_with("vec", "other", lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    return both.select("part", "id", same.alias("same"))


@query(
    "embed_whole",
    with_(
        *ROUTED_NEXT, PART_V,
        ("held", "SELECT id, count(*) AS n FROM pv GROUP BY id"),
        ("anchor", "SELECT part FROM pv GROUP BY part ORDER BY count(*) DESC, part LIMIT 1"),
        select=f"""SELECT id, CASE WHEN n = {PARTS} THEN 1 ELSE n END AS n_rows,
          id IN (SELECT id FROM pv WHERE part = (SELECT part FROM anchor)) AS as_trained FROM held""",
    ),
)
def embed_whole(spark, sf):
    """The whole job with training, down to the written lines: the anchor's vectors are those that were
    trained, the core comes once, and other vertices once per part that has them."""
    edges = Store(spark, "embed-whole").save(routed_next(spark, sf), "edges")
    path = Store(spark, "embed-whole").path("lines")
    options = {**TRAIN, "dim": 4}
    embed.embed_job(edges, PARTS, "walks", out_path=path, ridge=1e-3, **options)
    trained = embed.embed_parts(edges, "walks", **options)
    anchor = align.anchor_part(trained).select("part")
    anchored = trained.join(F.broadcast(anchor), "part").select("id", F.col("vec").alias("own"))
    near = F.forall(F.zip_with("vec", "own", lambda a, b: F.abs(a - b) < 1e-6), lambda x: x)
    lines = parse_embeddings(spark.read.text(path)).join(anchored, "id", "left")
    found = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.coalesce(near, F.lit(False))).alias("as_trained"))
    return found


# --- alignment ----------------------------------------------------------------------

PE = [SQL_PART_EMB]
CORE_IDS = ("core", f"SELECT id FROM pe GROUP BY id HAVING count(*) = {PARTS}")


@query("core_by_count", with_(*PE, CORE_IDS, select="SELECT id FROM core"))
def core_by_count(spark, sf):
    return align.core_by_count(part_emb(spark, sf), PARTS)


@query("anchor_part", with_(*PE, select="SELECT part, count(*) AS n_rows FROM pe GROUP BY part ORDER BY n_rows DESC, part LIMIT 1"))
def anchor_part(spark, sf):
    return align.anchor_part(part_emb(spark, sf))


@query(
    "core_embeddings",
    with_(*PE, CORE_IDS, ("ce", "SELECT part, id, vec FROM pe WHERE id IN (SELECT id FROM core)"), select=sql_values("ce", "part, id", "vec")),
)
def core_embeddings(spark, sf):
    return values(align.core_embeddings(part_emb(spark, sf), PARTS), ["part", "id"], "vec")


@query(
    "align_gram",
    with_(
        *PE, CORE_IDS,
        ("x", "SELECT part, id, generate_subscripts(vec, 1) - 1 AS i, unnest(vec) AS x FROM pe WHERE id IN (SELECT id FROM core)"),
        select=f"""SELECT a.part, (a.i * 64 + b.i)::INTEGER AS pos, {sql_round('sum(a.x * b.x)')} AS gram, {sql_round('sum(a.x * y.x)')} AS xy
        FROM x a JOIN x b ON a.part = b.part AND a.id = b.id
        JOIN x y ON y.part = 0 AND y.id = a.id AND y.i = b.i GROUP BY a.part, a.i, b.i""",
    ),
)
def align_gram(spark, sf):
    pairs = align.core_pairs(align.core_embeddings(part_emb(spark, sf), PARTS), anchor=0)
    sums = align.align_gram(pairs).select("part", F.posexplode(F.arrays_zip("gram", "cross")).alias("pos", "s"))
    return sums.select("part", "pos", rounded("s.gram").alias("gram"), rounded("s.cross").alias("xy"))


@query("align_residual", with_(*PE, CORE_IDS, select=f"SELECT part, (SELECT count(*) FROM core) AS n, 0.0::DOUBLE AS sse FROM pe GROUP BY part"))
def align_residual(spark, sf):
    pe = part_emb(spark, sf)
    out = align.align_residual(pe, PARTS, 0, align.fit_alignment(pe, PARTS, 0))
    return out.withColumn("sse", rounded("sse"))


MERGED = "WITH m AS (SELECT vec_id AS id, embedding AS vec FROM embeddings) " + sql_values("m", "id", "vec")


@query("emb_merge", MERGED)
def emb_merge(spark, sf):
    return values(align.merge_embeddings(part_emb(spark, sf), PARTS), ["id"], "vec")


@query("embed_align", MERGED)
def embed_align(spark, sf):
    """The whole job with a given training function, down to the written lines."""
    path = Store(spark, "embed-align").path("lines")
    embed.embed_job(routed_next(spark, sf), PARTS, lambda edges: part_emb(spark, sf), out_path=path)
    return values(parse_embeddings(spark.read.text(path)), ["id"], "vec")
