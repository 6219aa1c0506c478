"""Training data: part graphs, random walks, pairs, negative samples, sampled neighbours.

`by` names key columns that separate independent graphs in one table (usually `part`), so
all parts advance in the same job. Vertices are keyed by `by` + id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corepart.functions import draw
from corepart.operators.order import dense_index, running_total
from corepart.operators.route import missing_features
from corepart.operators.skew import Hubs, find_hubs, lookup
from corepart.store import Store

HOT_VERTICES = 100_000  # that may be broadcast with their numbers of copies
WEIGHT_UNIT = 1_000_000  # sampling weights are whole millionths, so that sums are exact


def part_edge_lines(part_edges: DataFrame) -> DataFrame:
    """Directed edges per part, from text or number columns; bad rows are dropped."""
    src, dst = F.col("src").try_cast("bigint"), F.col("dst").try_cast("bigint")
    rows = part_edges.select("part", src.alias("src"), dst.alias("dst"))
    return rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def part_edges_clean(part_edges: DataFrame) -> DataFrame:
    """The distinct ones of `part_edge_lines`."""
    return part_edge_lines(part_edges).distinct()


def part_vertices(part_edges: DataFrame) -> DataFrame:
    return part_edges.select("part", F.explode(F.array("src", "dst")).alias("id")).distinct()


def part_graph(part_edges: DataFrame, hubs: Hubs | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean edges (part, src, dst, src_idx, dst_idx) and vertices (part, id, idx).

    idx counts the vertices of a part from 0 in id order.
    """
    store = Store(part_edges.sparkSession, "part-graph")
    edges = store.save(part_edges_clean(part_edges), "edges")
    placed = store.save(dense_index(part_vertices(edges), ["part", "id"]), "positions")
    first = placed.groupBy("part").agg(F.min("pos").alias("first"))  # one row per part
    v = placed.join(F.broadcast(first), "part").select("part", "id", (F.col("pos") - F.col("first")).alias("idx"))
    v = store.save(v, "vertices")
    hubs = find_hubs(edges) if hubs is None else hubs
    out = lookup(edges, "src", v.withColumnRenamed("idx", "src_idx"), hubs, ("dst",), by=("part",))
    out = lookup(out, "dst", v.withColumnRenamed("idx", "dst_idx"), hubs, ("src",), by=("part",))
    return out.select("part", "src", "dst", "src_idx", "dst_idx"), v


def part_graph_feats(v: DataFrame, feats: DataFrame, check: bool = True) -> DataFrame:
    """(part, id, feat) for the vertices of part graphs; missing features are an error."""
    if check:
        missing_features(v, feats)
    return v.join(feats, "id").select("part", "id", "feat")


# --- random walks -------------------------------------------------------------------


WALKERS = 1_000_000  # walkers that one row of the index should meet in a step


class WalkIndex:
    """Out-neighbours as one globally numbered list: neighbour j of v is row start(v) + j.

    A step of a walk is then two equi-joins, whatever the degree; no task holds the
    neighbour list of a hub. Both tables lie in buckets of their keys, so a step shuffles walkers
    only. Where many edges come in, many walkers will stand: with `per_node` walks from every
    vertex, about per_node times the in-degree. A vertex that expects more than WALKERS of them has its
    row of `starts`, and where its own edges are few also its list, as many times as needed, and walkers are spread over
    the copies.
    """

    def __init__(self, edges: DataFrame, by: tuple[str, ...] = (), per_node: int = 1, walkers: int = WALKERS):
        self.by = by
        self.store = Store(edges.sparkSession, "walk-index")
        simple = self.store.save(edges.select(*by, "src", "dst").distinct(), "simple")
        ends = F.array(*(F.struct(F.col(c).alias("id"), F.lit(out).alias("out")) for c, out in (("src", 1), ("dst", 0))))
        degrees = simple.select(*by, F.inline(ends)).groupBy(*by, "id")
        degrees = degrees.agg(F.sum("out").alias("deg"), (F.count(F.lit(1)) - F.sum("out")).alias("came"))
        expected = (F.col("came") + 1) * per_node
        fans = degrees.select(
            *by, "id", "deg",
            F.ceil(expected / walkers).cast("int").alias("fan"),
            F.greatest(F.ceil(expected / (F.greatest("deg", F.lit(1)) * walkers)), F.lit(1)).cast("int").alias("copies"),
        )
        self.vertices = self.store.save(fans, "vertices")
        # A vertex with a fan or copies has more than `walkers` / per_node edges: few, and named to every task.
        many = self.vertices.where("fan > 1 OR copies > 1").select(*by, "id", "fan", "copies")
        named = many.orderBy(F.desc("fan"), *by, "id").limit(HOT_VERTICES).collect()
        schema = self.vertices.select(*by, "id", "fan", "copies").schema
        self.hot = edges.sparkSession.createDataFrame(named, schema) if named else None
        copied = simple
        if self.hot is not None:
            hot = F.broadcast(self.hot.select(*by, F.col("id").alias("src"), "copies"))
            copied = simple.join(hot, [*by, "src"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
            copied = copied.drop("copies")
        else:
            copied = simple.withColumn("copy", F.lit(0))
        numbered = dense_index(copied, [*by, "src", "copy", "dst"], store=self.store)
        self.rows = self.store.save(numbered, "numbered")
        starts = self.rows.groupBy(*by, "src").agg(F.min("pos").alias("start"), F.count_if(F.col("copy") == 0).alias("deg"))
        starts = starts.withColumnRenamed("src", "id").withColumn("_slot", F.lit(0))
        if self.hot is not None:
            fan = F.broadcast(self.hot.select(*by, "id", "fan", "copies"))
            starts = starts.drop("_slot").join(fan, [*by, "id"], "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)))
            starts = starts.drop("fan")
        else:
            starts = starts.withColumn("copies", F.lit(1))
        starts = starts.withColumn("copies", F.coalesce("copies", F.lit(1)))
        self.starts = self.store.save_bucketed(starts, "starts", [*by, "id", "_slot"])
        self.targets = self.store.save_bucketed(self.rows.select("pos", F.col("dst").alias("cand")), "targets", ["pos"])
        self._known = None

    def known(self) -> DataFrame:
        """(by, prev, cand, adjacent): the edges, in buckets of both ends."""
        if self._known is None:
            rows = self.rows.where("copy = 0").select(*self.by, F.col("src").alias("prev"), F.col("dst").alias("cand"), F.lit(True).alias("adjacent"))
            self._known = self.store.save_bucketed(rows, "known", [*self.by, "prev", "cand"])
        return self._known

    def pick(self, walkers: DataFrame, u) -> DataFrame:
        """Add `cand`: a uniform out-neighbour of `cur`, null where there is none."""
        spread = F.xxhash64("origin", "walk", F.lit("spread"))
        if self.hot is not None:
            hot = F.broadcast(self.hot.select(*self.by, F.col("id").alias("cur"), "fan"))
            walkers = walkers.join(hot, [*self.by, "cur"], "left")
            walkers = walkers.withColumn("_slot", F.pmod(spread, F.coalesce("fan", F.lit(1)).cast("bigint")).cast("int")).drop("fan")
        else:
            walkers = walkers.withColumn("_slot", F.lit(0))
        at = walkers.join(self.starts.withColumnRenamed("id", "cur"), [*self.by, "cur", "_slot"], "left")
        # Walkers at dead ends get places that no edge has, all different, not one null key.
        nowhere = F.lit(-1).cast("bigint") - F.pmod(F.xxhash64("origin", "walk"), F.lit(1 << 62))
        copy = F.pmod(F.xxhash64("origin", "walk", F.lit("copy")), F.col("copies").cast("bigint"))
        pos = F.coalesce(F.col("start") + copy * F.col("deg") + F.floor(u * F.col("deg")), nowhere)
        at = at.withColumn("pos", pos).drop("start", "deg", "copies", "_slot")
        return at.join(self.targets, "pos", "left").drop("pos")


def random_walks(
    edges: DataFrame,
    length: int = 4,
    per_node: int = 2,
    seed: int = 0,
    p: float = 1.0,
    q: float = 1.0,
    by: tuple[str, ...] = (),
    walkers: int = WALKERS,
) -> DataFrame:
    """(by, origin, walk, path): `per_node` walks of `length` vertices from every vertex.

    A vertex without out-edges repeats itself. With p or q other than 1, a step from v with
    predecessor t goes back to t with weight 1/p, to an out-neighbour of t with weight 1, and
    elsewhere with weight 1/q. Biased steps draw a uniform neighbour and accept it in proportion
    to its weight, until all walkers have accepted: exact, and no neighbour list is expanded.
    """
    index = WalkIndex(edges, by, per_node, walkers)
    store, biased = index.store, (p, q) != (1.0, 1.0)
    verts = index.vertices.select(*by, F.col("id").alias("origin"))
    walkers = verts.select(
        *by, "origin", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk")
    ).withColumn("path", F.array("origin"))
    keys = [*by, "origin", "walk"]
    for step in range(1, length):
        at = walkers.withColumn("cur", F.element_at("path", -1))
        if biased and step > 1:
            walkers = _biased_step(index, at, step, seed, p, q, keys)
        else:
            picked = index.pick(at, draw(*keys, salt=f"{seed}:walk:{step}"))
            grown = F.concat("path", F.array(F.coalesce("cand", "cur")))
            walkers = picked.select(*keys, grown.alias("path"))
    out = store.save(walkers, "walks")
    store.keep_only("walks")
    return out


def _biased_step(index: WalkIndex, at: DataFrame, step: int, seed: int, p: float, q: float, keys) -> DataFrame:
    """One step by rejection: several numbered tries per job, the first accepted one counts."""
    top = max(1.0 / p, 1.0, 1.0 / q)
    back, near, far = (1.0 / p) / top, 1.0 / top, (1.0 / q) / top
    known = index.known()
    weight = (
        F.when(F.col("cand") == F.col("prev"), back)
        .when(F.coalesce("adjacent", F.lit(False)), near)
        .otherwise(far)
    )
    accept = F.col("cand").isNull() | (draw(*keys, "try", salt=f"{seed}:accept:{step}") < weight)
    store, done = index.store, []
    waiting, first, tries = store.save(at, f"step-{step}-0"), 0, 4
    while True:
        numbered = waiting.withColumn("prev", F.element_at("path", -2)).withColumn(
            "try", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1)))
        )
        picked = index.pick(numbered, draw(*keys, "try", salt=f"{seed}:walk:{step}"))
        judged = picked.join(known, [*index.by, "prev", "cand"], "left")
        best = F.min(F.when(accept, F.struct("try", F.coalesce("cand", "cur").alias("next"))))
        tried = judged.groupBy(*keys).agg(
            best.alias("best"), F.any_value("path").alias("path"), F.any_value("cur").alias("cur")
        )
        tried = store.save(tried, f"step-{step}-from-{first}")
        grown = F.concat("path", F.array("best.next"))
        done.append(tried.where("best is not null").select(*keys, grown.alias("path")))
        waiting = tried.where("best is null").select(*keys, "path", "cur")
        first, tries = first + tries, 16
        if waiting.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return store.save(out, f"step-{step}")


def walk_pairs(walks: DataFrame, context: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, origin, walk, j, i, src, dst): pairs (j, j + i) of a walk, 0 < i < context."""
    spots = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("path") - context),
            lambda j: F.transform(
                F.sequence(F.lit(1), F.lit(context - 1)),
                lambda i: F.struct(
                    j.alias("j"),
                    i.alias("i"),
                    F.get("path", j).alias("src"),
                    F.get("path", j + i).alias("dst"),
                ),
            ),
        )
    )
    return walks.where(F.size("path") >= context).select(*by, "origin", "walk", F.inline(spots))


# --- negative samples ---------------------------------------------------------------


def neg_weights(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, in_degree, weight): in-degree over distinct edges to the power 0.75."""
    simple = edges.select(*by, "src", "dst").distinct()
    deg = simple.groupBy(*by, "dst").agg(F.count(F.lit(1)).alias("in_degree"))
    return deg.select(*by, F.col("dst").alias("id"), "in_degree", F.pow("in_degree", F.lit(0.75)).alias("weight"))


@dataclass(frozen=True)
class WeightLine:
    """Weights as intervals on a line, which many draws may meet: a table, cut into buckets of `width`, of which it has `total` units."""

    line: DataFrame
    width: int
    total: int


def weight_line(weights: DataFrame, by: tuple[str, ...] = ()) -> WeightLine:
    """The line of `weights(by, id, weight)`, written to a table."""
    store = Store(weights.sparkSession, "weighted-choice")
    whole = F.round(F.col("weight") * WEIGHT_UNIT).cast("bigint")
    lost = F.raise_error(F.lit("a positive weight is too small: scale the weights up"))
    kept = F.when((F.col("weight") > 0) & (whole == 0), lost).otherwise(whole)
    w = weights.select(*by, "id", kept.cast("bigint").alias("w")).where("w > 0")
    line = store.save(running_total(w, [*by, "id"], "w"), "line")
    n, total = line.agg(F.count(F.lit(1)), F.max("upto")).first()
    return WeightLine(line, max(1, (total or 0) // max(n, 1)), total or 0)


def weighted_choice(
    draws: DataFrame, weights: DataFrame | WeightLine, by: tuple[str, ...] = (), out: str = "dst"
) -> DataFrame:
    """Add `out`: an id drawn by weight for each row of `draws` (its column `u` in [0, 1)).

    Weights become intervals on a line, the line is cut into as many buckets as there are
    weights, and draws meet intervals by bucket: an equi-join with a range filter.
    """
    made = weights if isinstance(weights, WeightLine) else weight_line(weights, by)
    line, width, total = made.line, made.width, made.total
    lo, hi = F.col("upto") - F.col("w"), F.col("upto") - 1
    intervals = line.select(
        lo.alias("lo"),
        hi.alias("hi"),
        F.col("id").alias(out),
        F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("bucket"),
    )
    if by:
        spans = line.groupBy(*by).agg(F.min(lo).alias("first"), F.sum("w").alias("span"))
        placed = draws.join(F.broadcast(spans), list(by))  # one row per graph
    else:
        placed = draws.withColumns({"first": F.lit(0).cast("bigint"), "span": F.lit(total).cast("bigint")})
    placed = (
        placed.withColumn("t", F.col("first") + F.floor(F.col("u") * F.col("span")))
        .withColumn("bucket", F.floor(F.col("t") / width))
        .drop("first", "span")
    )
    hit = placed.join(intervals, "bucket").where((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")))
    return hit.drop("bucket", "t", "lo", "hi", "u")


def negative_line(edges: DataFrame, by: tuple[str, ...] = (), uniform: bool = False) -> WeightLine:
    """What `negative_pairs` draws its targets from: the same for all epochs of a run."""
    if uniform:
        ends = F.explode(F.array("src", "dst")).alias("id")
        return weight_line(edges.select(*by, ends).distinct().withColumn("weight", F.lit(1.0)), by)
    return weight_line(neg_weights(edges, by), by)


def negative_pairs(
    pairs: DataFrame,
    edges: DataFrame | WeightLine,
    k: int = 1,
    seed: int = 0,
    share: bool = False,
    key: tuple[str, ...] = ("src", "dst"),
    by: tuple[str, ...] = (),
    uniform: bool = False,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """(by, key, src, neg, neg_dst): k random targets for every positive pair.

    Targets are drawn by in-degree to the power 0.75, or with `uniform` from all vertices alike; `edges` may be
    the `negative_line` of the edges.

    `key` identifies a pair. With `share`, k consecutive pairs (in key order) use one set of k
    targets; if the pair count is not divisible by k, each pair draws its own. With `by`, every
    graph counts and numbers its own pairs. `keep` names the columns to return with a target instead of `by`, `key` and `src`:
    what is needed afterwards travels along, and nothing else does.
    """
    own = [*by, *key] if "src" in key else [*by, *key, "src"]
    keep = own if keep is None else [*keep]
    rows = pairs.select(*dict.fromkeys([*own, *keep]))
    ids = [*by, *key]
    salt = f"{seed}:negative"
    u = draw(*ids, "neg", salt=salt)
    if share:
        rows = dense_index(rows, ids)
        whole = rows.groupBy(*by).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        # one row per graph
        rows = rows.join(F.broadcast(whole), list(by)) if by else rows.join(F.broadcast(whole), F.lit(True))
        rows = rows.withColumn("grp", F.floor((F.col("pos") - F.col("_first")) / k))
        u = F.when(F.col("_n") % k == 0, draw(*by, "grp", "neg", salt=salt)).otherwise(u)
    draws = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("neg"))
    draws = draws.select(*dict.fromkeys([*by, *keep]), "neg", u.alias("u"))
    line = edges if isinstance(edges, WeightLine) else negative_line(edges, by, uniform)
    out = weighted_choice(draws, line, by, out="neg_dst")
    return out.select(*keep, "neg", "neg_dst")


# --- sampled neighbours -------------------------------------------------------------


def sample_in_neighbors(
    seeds: DataFrame,
    edges: DataFrame,
    fanout: int,
    salt: str,
    by: tuple[str, ...] = (),
    hubs: Hubs | None = None,
) -> DataFrame:
    """(by, dst, src): at most `fanout` random in-neighbours of each seed, without replacement.

    The rank filter is pushed below the shuffle, so a hub sends `fanout` rows per task, not
    its whole neighbour list.
    """
    near = edges if seeds is None else lookup(edges, "dst", seeds.select(*by, "id"), hubs, ("src",), by)
    first = W.partitionBy(*by, "dst").orderBy("u", "src")
    ranked = near.select(*by, "dst", "src", draw(*by, "src", "dst", salt=salt).alias("u"))
    return ranked.withColumn("rk", F.row_number().over(first)).where(F.col("rk") <= fanout).drop("rk", "u")


def sample_neighbors(
    seeds: DataFrame,
    edges: DataFrame,
    fanouts: tuple[int, ...] = (5, 10),
    seed: int = 0,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """(by, layer, dst, src): layered sampling; the last fan-out applies to the seeds (layer 0),
    the one before to the seeds and their sampled neighbours (layer 1), and so on."""
    store = Store(edges.sparkSession, "sample-neighbors")
    simple = store.save(edges.select(*by, "src", "dst").distinct(), "edges")
    hubs = find_hubs(simple, "dst")
    frontier, layers = seeds.select(*by, "id").distinct(), []
    for layer, fanout in enumerate(reversed(fanouts)):
        got = sample_in_neighbors(frontier, simple, fanout, f"{seed}:layer:{layer}", by, hubs)
        got = store.save(got, f"layer-{layer}")
        layers.append(got.withColumn("layer", F.lit(layer)))
        frontier = frontier.unionByName(got.select(*by, F.col("src").alias("id"))).distinct()
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more)
    return out.select(*by, "layer", "dst", "src")
