"""A vertex with a third of all edges: the hub path must give the same rows as the plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corepart.operators import graph, labels, route, sage, walks
from corepart.operators.skew import Hubs, find_hubs, lookup, resident
from corepart.plans import partition
from corepart.store import Store


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def hubs(hub_edges):
    found = find_hubs(hub_edges, min_rows=20)
    assert dict(found.fans)[0] == 8  # 150 rows in slots of 20
    return found


@pytest.fixture(scope="module")
def state(hub_edges):
    deg = graph.degrees(hub_edges)
    return deg.select("id", (F.col("id") % 3).cast("int").alias("label"), F.col("degree").cast("double").alias("score")).cache()


def test_hub_table_is_bounded(hub_edges):
    assert len(find_hubs(hub_edges, min_rows=1, top=5).fans) == 5
    assert not find_hubs(hub_edges)


def test_hub_rows_are_spread_and_hold_the_limit(hub_edges, hubs):
    slots = resident(hub_edges, "src", hubs, ("dst",))
    top = slots.where("src = 0").groupBy("_slot").count().agg(F.max("count")).first()[0]
    assert slots.where("src = 0").select("_slot").distinct().count() > 1
    assert top < 100
    slots.unpersist()


def test_lookup_left_join(hub_edges, hubs, state):
    some = state.where("id % 2 = 0").select("id", "label")
    plain = lookup(hub_edges, "src", some, how="left").select("src", "dst", "label")
    salted = lookup(hub_edges, "src", some, hubs, ("dst",), how="left").select("src", "dst", "label")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, salted.collect()), key=key)


@pytest.mark.parametrize(
    "run",
    [
        lambda e, s, h: graph.triplets(e, s, "label", h),
        lambda e, s, h: graph.induced(e, s.where("label > 0"), h),
        lambda e, s, h: graph.intra_part_edges(e, s.withColumnRenamed("label", "part"), h),
        lambda e, s, h: route.route_edges(e, s.withColumnRenamed("label", "part"), 2, h),
        lambda e, s, h: labels.neigh_label_freq(graph.adjacency(e), s, h),
        lambda e, s, h: graph.components(s, e, h),
        lambda e, s, h: partition.noncore_edges(e, s.where("label = 0"), h),
        lambda e, s, h: walks.random_walks(e, seed=5, walkers=9 if h else 1000),
        lambda e, s, h: walks.random_walks(e, seed=5, p=0.5, q=2.0, walkers=9 if h else 1000),
        lambda e, s, h: walks.sample_in_neighbors(s.select("id"), e.distinct(), 3, "x", hubs=h),
        lambda e, s, h: graph.grow_core(e, 60, 4, h),
    ],
)
def test_same_rows(hub_edges, state, hubs, run):
    got = [rows(run(hub_edges, state, h).select(F.struct("*").cast("string"))) for h in (Hubs(), hubs)]
    assert got[0] == got[1] and got[0]


def test_same_ranks(hub_edges, hubs):
    a, b = (dict(rows(graph.pagerank(hub_edges, tol=None, max_iter=4, hubs=h))) for h in (Hubs(), hubs))
    assert a == pytest.approx(b)


def test_same_layers(hub_edges, state, hubs):
    layer = sage.Layer(np.eye(2), np.ones((2, 2)), np.zeros(2))
    h = state.select("id", F.array(F.col("score"), F.col("label").cast("double")).alias("feat"))
    out = [
        {r.id: r.feat for r in sage.sage_layer(h, hub_edges.distinct(), layer, hubs=x).collect()}
        for x in (Hubs(), hubs)
    ]
    assert out[0].keys() == out[1].keys()
    for k in out[0]:
        assert out[0][k] == pytest.approx(out[1][k])


def test_same_partitioning(hub_edges, hubs):
    run = [
        rows(partition.partition_with_core(hub_edges, 3, 0.05, max_rounds=3, tol=0.0, affinity="ratio", hubs=h).state)
        for h in (Hubs(), hubs)
    ]
    assert run[0] == run[1]


def test_kept_partitions_follow_the_table(spark, hub_edges, monkeypatch):
    from corepart.operators import skew

    table = Store(spark, "resident-test").save(hub_edges, "edges")
    assert resident(table, "src", None, ("dst",)).rdd.getNumPartitions() == 4
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(skew, "RESIDENT_BYTES", size // 20)
    assert resident(table, "dst", None, ("src",)).rdd.getNumPartitions() >= 20


def test_basket_pairs_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from corepart.checks.fixtures import g_basket
    from corepart.operators import skew

    lines = [(o, (o * 7 + k * k) % 40) for o in range(60) for k in range(5)] + [(None, 1), (None, 2), (3, None)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sorted({(p, q) for o, p in lines for o2, q in lines if o is not None and o == o2 and None not in (p, q) and p < q})
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    pairs = g_basket(spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() >= 20 and rows(pairs) == want
