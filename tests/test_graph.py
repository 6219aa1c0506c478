"""Graph operators and core extraction: properties and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from corepart.operators import graph, labels, route
from corepart.plans import partition
from corepart.store import Store


def union_find(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("case", ["path", "random", "stars"])
def test_components(spark, case):
    rnd = random.Random(5)
    n = 300
    perm = rnd.sample(range(n), n)
    pairs = {
        "path": [(perm[i], perm[i + 1]) for i in range(n - 1) if i % 100],
        "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(170)],
        "stars": [(perm[i // 60], perm[i]) for i in range(10, n)],
    }[case]
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    v = spark.range(n)
    got = {r.id: r.component for r in graph.components(v, e).collect()}
    assert got == union_find(pairs, range(n))


def test_components_without_edges(spark):
    e = spark.createDataFrame([], "src bigint, dst bigint")
    assert sorted(map(tuple, graph.components(spark.range(3), e).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert graph.largest_component(graph.components(spark.range(0), e)).isEmpty()


def test_largest_component_takes_the_lowest_id_on_a_tie(spark):
    comp = spark.createDataFrame([(5, 5), (6, 5), (2, 2), (3, 2), (9, 9)], "id bigint, component bigint")
    assert tuple(graph.largest_component(comp).first()) == (2, 2)


def test_pagerank_reaches_its_tolerance(spark, hub_edges):
    a = {r.id: r["rank"] for r in graph.pagerank(hub_edges, tol=1e-4).collect()}
    assert sum(a.values()) == pytest.approx(len(a))
    out = {}
    for r in hub_edges.collect():
        out.setdefault(r.src, []).append(r.dst)
    ranks = dict.fromkeys(a, 1.0)
    for _ in range(200):
        nxt = dict.fromkeys(a, 0.15)
        for s, ds in out.items():
            for d in ds:
                nxt[d] += 0.85 * ranks[s] / len(ds)
        ranks = nxt
    scale = len(a) / sum(ranks.values())
    assert a == pytest.approx({k: v * scale for k, v in ranks.items()}, abs=2e-3)


def test_grow_core_has_the_exact_size_and_is_connected(hub_edges):
    got = graph.grow_core(hub_edges, 50, 3)
    assert got.count() == 50 and got.select("id").distinct().count() == 50
    assert got.where("round = 0").count() == 1
    inner = graph.induced(hub_edges, got)
    assert graph.components(got, inner).select("component").distinct().count() == 1


def test_grow_core_stops_at_the_end_of_a_component(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "src bigint, dst bigint")
    got = {r.id for r in graph.grow_core(e, 10, 1).collect()}
    assert got in ({1, 2, 3}, {8, 9})


def test_core_rate_too_small_is_an_error(toy):
    with pytest.raises(ValueError, match="core rate"):
        partition.seed_core(toy, 2, 0.01, "degree", 1)


def test_core_rate_of_a_third_takes_everything(toy):
    state, _, _ = partition.seed_core(toy, 2, 0.34, "degree", 1)
    assert state.where("label <> 0").isEmpty()
    routed = route.route_edges(toy, state.withColumnRenamed("label", "part"), 2)
    assert routed.count() == 2 * toy.count()


def test_no_core_left(spark, toy):
    state = graph.vertices(toy).withColumn("label", F.lit(1))
    out = partition.extract_core(toy, state)
    assert out.kept == 0 and out.core.isEmpty() and out.edges.count() == toy.count()


def test_core_outside_the_largest_component_is_demoted(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], "src bigint, dst bigint")
    state = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 0)], "id bigint, label int")
    out = partition.extract_core(e, state)
    assert {r.id for r in out.core.collect()} == {1, 2} and (out.candidates, out.kept) == (3, 2)
    assert {r.id: r.mark for r in out.marks.collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1}
    assert sorted(map(tuple, out.edges.collect())) == [(3, 4), (4, 5), (5, 6)]


def test_report_agrees_with_the_operators(hub_edges):
    out = partition.partition_with_core(hub_edges, 3, 0.05, max_rounds=2, tol=0.0, affinity="ratio", seed=2)
    seeded, _, _ = partition.seed_core(hub_edges, 3, 0.05, "degree", 2)
    first = out.report[0]
    assert first["sizes"] == {r.label: r.size for r in labels.part_size(seeded).collect()}
    cut = route.edge_cut(graph.triplets(hub_edges, seeded, "label")).first()
    assert (first["cut_real"], first["cut_all"]) == (cut.cut_real, cut.cut_all)
    means = {r.label: r.mean_trunc_score for r in labels.part_score_mean(seeded).collect()}
    assert first["mean_trunc_score"] == pytest.approx(means)
    assert first["progress"] == float("inf") and len(out.report) == 2


def test_propagation_converges_and_keeps_all_vertices(hub_edges):
    out = partition.partition_with_core(hub_edges, 3, 0.05, tol=0.05, max_rounds=15, affinity="ratio")
    assert out.converged and len(out.report) < 15
    assert out.state.count() == graph.vertices(hub_edges).count()
    plain = partition.partition_plain(hub_edges, 3, tol=0.05, max_rounds=15)
    assert {r.part for r in plain.assignment().select("part").distinct().collect()} <= {0, 1, 2}


def test_routing_keeps_every_edge(hub_edges):
    a = graph.vertices(hub_edges).select("id", (F.col("id") % 4).cast("int").alias("part")).cache()
    routed = route.route_edges(hub_edges, a, 3)
    ends = graph.edge_parts(hub_edges, a)
    core = ends.where("src_part = 0 and dst_part = 0").count()
    cut = route.cut_edges(graph.triplets(hub_edges, a, "part"), ignore_core=True, attr="part").count()
    assert routed.count() + cut == hub_edges.count() + 2 * core
    at = routed.join(a.withColumnRenamed("id", "src").withColumnRenamed("part", "p"), "src").join(
        a.withColumnRenamed("id", "dst").withColumnRenamed("part", "q"), "dst"
    )
    assert at.where("(p > 0 and p <> part) or (q > 0 and q <> part)").isEmpty()


def test_missing_vertices(spark):
    # core 1; part-1 vertex 2; missing 3..9
    e = spark.createDataFrame(
        [(1, 2), (3, 1), (4, 5), (6, 2), (7, 7), (8, 6), (9, 2)], "src bigint, dst bigint"
    )
    a = spark.createDataFrame([(1, 0), (2, 1)], "id bigint, part int")
    got = {r.id: r.part for r in route.assign_missing(e, a, 3, 1).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8}  # 9 touches only an assigned non-core vertex
    assert got[4] == got[5] and got[6] == got[8] and all(1 <= got[i] <= 3 for i in range(3, 9))


def test_pagerank_says_when_it_has_not_converged(toy):
    with pytest.raises(RuntimeError, match="not converged"):
        graph.pagerank(toy, tol=1e-9, max_iter=2)


def test_part_graphs_keep_self_loops(spark):
    e = spark.createDataFrame([(8, 8), (8, 9), (9, 8), (8, 7)], "src bigint, dst bigint")
    parts = spark.createDataFrame([(7, 2), (8, 1), (9, 1)], "id bigint, part int")
    got = route.part_with_core_edges(e, parts, 2).collect()
    assert sorted((r.part, r.src, r.dst) for r in got) == [(1, 8, 8), (1, 8, 9)]


def test_contraction_has_fewer_edges_in_each_round(spark):
    import random

    rnd = random.Random(4)
    path = rnd.sample(range(600), 600)
    rows = list(zip(path, path[1:], strict=False)) + [(1000, 1000 + i) for i in range(1, 200)] + [(3000 + rnd.randrange(80), 3000 + rnd.randrange(80)) for _ in range(90)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint").cache()
    edges = []
    got = {r.id: r.component for r in graph.components(graph.vertices(e), e, history=edges, few=0).collect()}
    assert all(a > b for a, b in zip(edges, edges[1:], strict=False)) and len(edges) < 14
    root = {v: v for r in rows for v in r}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in root}
    for few in (50, 10**6):  # one task ends the work early, or does all of it
        assert got == {r.id: r.component for r in graph.components(graph.vertices(e), e, few=few).collect()}


def test_settled_ranks_are_not_sent_again(spark):
    """Leaves point into a long chain: after the first rounds only the chain still changes."""
    rows = [(100 + i, 0) for i in range(300)] + [(i, i + 1) for i in range(40)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint")
    seen = []
    ranks = {r.id: r["rank"] for r in graph.pagerank(e, tol=1e-3, history=seen).collect()}
    sent = [h["links"] for h in seen]
    assert sent[0] == 340 and sent[1] == 301 and sent[2] <= 40 and all(a >= b for a, b in zip(sent, sent[1:], strict=False)) and sent[-1] < 10
    want = dict.fromkeys(ranks, 0.15)
    want[0] = 0.15 + 0.85 * 300 * 0.15
    for i in range(40):
        want[i + 1] = 0.15 + 0.85 * want[i]
    scale = len(want) / sum(want.values())
    assert ranks == pytest.approx({k: v * scale for k, v in want.items()}, abs=2e-3)


def test_links_of_ranks_are_dealt_by_the_size_of_the_pairs(spark, toy, monkeypatch):
    from corepart.operators import skew

    seen, plain = [], graph.lookup

    def lookup(rows, *more, **named):
        seen.append(rows.rdd.getNumPartitions())
        return plain(rows, *more, **named)

    want = {r.id: r.rank for r in graph.pagerank(toy, tol=None, max_iter=2).collect()}
    monkeypatch.setattr(skew, "RESIDENT_BYTES", 50)
    monkeypatch.setattr(graph, "lookup", lookup)
    got = {r.id: r.rank for r in graph.pagerank(toy, tol=None, max_iter=2).collect()}
    assert seen[0] > 4 and got == pytest.approx(want)  # the session has 4


def test_components_send_no_vertex_table_to_the_driver(spark, monkeypatch):
    """Tables of vertices are small as files: without a hint their joins would be broadcast."""
    plans, plain = [], Store.save

    def save(self, df, tag, *more):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return plain(self, df, tag, *more)

    monkeypatch.setattr(Store, "save", save)
    e = spark.range(300).select("id", (F.col("id") + 5).alias("dst")).withColumnRenamed("id", "src")
    comp = graph.components(graph.vertices(e), e, few=20)
    assert {r.component for r in comp.select("component").distinct().collect()} == set(range(5))
    assert len(plans) > 5 and not [tag for tag, plan in plans if "BroadcastHashJoin" in plan]
