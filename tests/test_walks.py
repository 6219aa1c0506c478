"""Walks and samples against plain Python on a small graph."""

import hashlib
from collections import defaultdict

import pytest
from plan_text import exchanges_below
from pyspark.sql import functions as F

from corepart.operators import walks
from corepart.store import Store, checkpoint_root


def u(*keys, salt):
    text = ":".join([*map(str, keys), salt])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13


def neighbours(edges):
    out = defaultdict(list)
    for s, d in sorted({(r.src, r.dst) for r in edges.collect()}):
        out[s].append(d)
    return out


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (0.25, 4.0), (4.0, 0.5)])
def test_walks(hub_edges, p, q):
    near = neighbours(hub_edges)
    ids = set(near) | {d for ds in near.values() for d in ds}
    top = max(1 / p, 1.0, 1 / q)

    def walk(v, w):
        path = [v]
        for step in range(1, 4):
            cur = path[-1]
            ds = near.get(cur, [])
            if not ds:
                path.append(cur)
            elif step == 1 or (p, q) == (1.0, 1.0):
                path.append(ds[int(u(v, w, salt=f"9:walk:{step}") * len(ds))])
            else:
                prev, n = path[-2], 0
                while True:
                    x = ds[int(u(v, w, n, salt=f"9:walk:{step}") * len(ds))]
                    weight = 1 / p if x == prev else 1.0 if x in near.get(prev, []) else 1 / q
                    if u(v, w, n, salt=f"9:accept:{step}") < weight / top:
                        path.append(x)
                        break
                    n += 1
        return path

    got = {(r.origin, r.walk): r.path for r in walks.random_walks(hub_edges, 4, 2, 9, p, q).collect()}
    assert got == {(v, w): walk(v, w) for v in ids for w in range(2)}


def test_pairs(spark):
    w = spark.createDataFrame([(1, 0, [1, 2, 3, 4])], "origin bigint, walk int, path array<bigint>")
    assert [(r.src, r.dst) for r in walks.walk_pairs(w, 2).orderBy("j").collect()] == [(1, 2), (2, 3), (3, 4)]
    assert walks.walk_pairs(w, 5).isEmpty()


def test_samples_have_no_repeats_and_keep_the_fanout(hub_edges):
    simple = hub_edges.distinct()
    got = walks.sample_in_neighbors(None, simple, 5, "z")
    deg = simple.groupBy("dst").count()
    both = got.groupBy("dst").agg(F.count("*").alias("n"), F.countDistinct("src").alias("d")).join(deg, "dst")
    assert both.where("n <> d or n <> least(5, `count`)").isEmpty()
    assert both.count() == deg.count()


def test_shared_negatives_fall_back(spark):
    e = spark.createDataFrame([(i, (i * 7) % 10) for i in range(10)], "src bigint, dst bigint")
    shared = walks.negative_pairs(e, e, 5, 1, share=True).collect()
    groups = defaultdict(set)
    for r in shared:
        groups[r.src // 5, r.neg].add(r.neg_dst)
    assert len(shared) == 50 and all(len(g) == 1 for g in groups.values())
    own = walks.negative_pairs(e, e, 4, 1, share=True)
    assert own.count() == 40 and own.exceptAll(walks.negative_pairs(e, e, 4, 1)).isEmpty()


def test_shared_negatives_count_each_part(spark):
    e = spark.createDataFrame([(p, i, i + 1) for p in (1, 2) for i in range(3)], "part int, src bigint, dst bigint")
    shared = walks.negative_pairs(e, e, 2, 1, share=True, by=("part",))
    assert shared.exceptAll(walks.negative_pairs(e, e, 2, 1, by=("part",))).isEmpty()  # 3 pairs each: own draws


def test_weights_that_vanish_are_an_error(spark):
    draws = spark.createDataFrame([(1, 0.5)], "k int, u double")
    weights = spark.createDataFrame([(1, 1.0), (2, 1e-9)], "id bigint, weight double")
    with pytest.raises(Exception, match="too small"):
        walks.weighted_choice(draws, weights).collect()


def test_part_graph_drops_bad_and_double_rows(spark):
    raw = spark.createDataFrame(
        [(1, "1", "2"), (1, "1", "2"), (1, "2", "1"), (1, "x", "3"), (2, "5", "9")], "part int, src string, dst string"
    )
    edges, v = walks.part_graph(raw)
    assert sorted((r.part, r.src, r.dst, r.src_idx, r.dst_idx) for r in edges.collect()) == [
        (1, 1, 2, 0, 1),
        (1, 2, 1, 1, 0),
        (2, 5, 9, 0, 1),
    ]
    assert sorted(map(tuple, v.collect())) == [(1, 1, 0), (1, 2, 1), (2, 5, 0), (2, 9, 1)]


def test_missing_features_are_named(spark):
    v = spark.createDataFrame([(1, 7), (1, 8)], "part int, id bigint")
    feats = spark.createDataFrame([(7, [1.0])], "id bigint, feat array<double>")
    with pytest.raises(ValueError, match="8"):
        walks.part_graph_feats(v, feats)


def test_a_step_shuffles_walkers_only(spark, hub_edges, sort_merge_only):
    index = walks.WalkIndex(hub_edges, per_node=2, walkers=20)
    at = spark.range(100).select(F.col("id").alias("origin"), F.lit(0).alias("walk"), F.col("id").alias("cur"))
    plan = index.pick(at, F.rand(1))._jdf.queryExecution().executedPlan().toString()
    for table in ("starts", "targets"):
        assert not exchanges_below(plan, index.store.tables[table])
    near = at.select("origin", F.col("cur").alias("prev"), (F.col("origin") + 1).alias("cand")).join(index.known(), ["prev", "cand"], "left")
    assert not exchanges_below(near._jdf.queryExecution().executedPlan().toString(), index.store.tables["known"])


def test_walkers_on_a_bipartite_graph_are_spread(spark, sort_merge_only):
    """All of 4000 vertices point to one of two, which point to three: no copy of a row meets most walkers."""
    edges = spark.range(4000).select((F.col("id") + 10).alias("src"), (F.col("id") % 2).alias("dst"))
    back = spark.createDataFrame([(0, 10), (0, 11), (0, 12), (1, 10), (1, 11), (1, 12)], "src bigint, dst bigint")
    index = walks.WalkIndex(edges.union(back), per_node=2, walkers=100)
    fans = {r.id: (r.fan, r.copies) for r in index.vertices.where("fan > 1 OR copies > 1").collect()}
    assert fans == {0: (41, 14), 1: (41, 14)}  # 2001 come in, two walks each, 100 a row
    at = edges.select(F.col("src").alias("origin"), F.explode(F.array(F.lit(0), F.lit(1))).alias("walk"), F.col("dst").alias("cur"))
    spread = F.pmod(F.xxhash64("origin", "walk", F.lit("spread")), F.lit(41)).alias("s")
    met = at.groupBy("cur", spread).count().agg(F.max("count")).first()[0]
    assert met < 4 * 100
    picked = index.pick(at, F.rand(3))
    assert picked.where("cand is null").isEmpty() and picked.count() == 8000
    shares = {r.cand: r["count"] for r in picked.groupBy("cand").count().collect()}
    assert set(shares) == {10, 11, 12} and max(shares.values()) < 1.15 * min(shares.values())


def test_walks_leave_their_result_only(spark, hub_edges):
    before = set(Store(spark, "x", checkpoint_root(spark)).names())
    walks.random_walks(hub_edges, seed=2).count()
    new = [n for n in Store(spark, "x", checkpoint_root(spark)).names() if n not in before and n.startswith("walk-index")]
    assert len(new) == 1 and Store(spark, "x", f"{checkpoint_root(spark)}/{new[0]}").names() == ["walks"]
