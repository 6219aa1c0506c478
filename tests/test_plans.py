"""Physical plans: what must not be in them, and what must."""

import pytest
from plan_text import exchanges_below
from pyspark.sql import functions as F

from corepart.operators import graph, labels, route, walks
from corepart.operators.skew import resident
from corepart.plans import partition
from corepart.store import Store


@pytest.fixture
def no_broadcast(spark):
    """As on big tables, where no side is small enough to be sent everywhere."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_part(text):
    return text.split("== Initial Plan ==")[0]


def test_no_nested_loops(spark, hub_edges, no_broadcast):
    a = graph.vertices(hub_edges).select("id", (F.col("id") % 4).cast("int").alias("part"))
    e, w = hub_edges, walks.neg_weights(hub_edges)
    d = hub_edges.withColumn("u", F.rand(1))
    for df in (
        route.route_edges(e, a, 3),
        graph.triplets(e, a, "part"),
        graph.induced(e, a.where("part = 1")),
        route.part_features(a.select("id", F.array(F.lit(1.0)).alias("feat")), a, 3),
        walks.weighted_choice(d, w, out="neg"),
        labels.neigh_label_freq(graph.adjacency(e), a.withColumnRenamed("part", "label")),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, text


def test_sampling_limits_groups_before_the_shuffle(hub_edges):
    text = plan(walks.sample_in_neighbors(None, hub_edges, 5, "s"))
    partial, exchange = text.index("Partial"), text.rindex("Exchange hashpartitioning(dst")
    assert "WindowGroupLimit" in text and exchange < partial


def test_rounds_do_not_shuffle_the_edges(spark, hub_edges, no_broadcast):
    store = Store(spark, "plan-test")
    adj = resident(store.save(graph.weighted_adjacency(hub_edges), "adj"), "nbr", None, ("id",))
    state = store.save(graph.vertices(hub_edges).withColumn("label", F.lit(1)), "state")
    freq = labels.neigh_label_freq(adj, state)
    freq.collect()
    text = final_part(plan(freq))
    cached = text.index("InMemoryRelation")
    join = text.index("Join")
    assert "Exchange" not in text[join:cached], text
    adj.unpersist()


def test_label_counts_are_combined_before_the_shuffle(hub_edges):
    state = graph.vertices(hub_edges).withColumn("label", F.lit(1))
    text = plan(labels.neigh_label_freq(graph.adjacency(hub_edges), state))
    assert "partial_sum" in text or "partial_count" in text


def test_degrees_read_the_edges_once(spark, hub_edges):
    path = Store(spark, "plan-test").path("edges")
    hub_edges.write.parquet(path)
    assert plan(graph.degrees(spark.read.parquet(path))).count("FileScan") == 1


def test_label_counts_follow_the_moves(spark, hub_edges):
    """Counts changed by a round's moves equal counts made anew, also where labels vanish."""
    adj = graph.weighted_adjacency(hub_edges)
    ids = graph.vertices(hub_edges)
    state = ids.select("id", (F.col("id") % 4).cast("int").alias("label"))
    before = labels.label_counts(labels.neigh_label_freq(adj, state))
    moves = state.select("id", F.col("label").alias("old_label"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int").alias("new_label"))
    moves = moves.where("id % 3 = 0 AND old_label <> new_label")
    after = state.join(moves.drop("old_label"), "id", "left").select("id", F.coalesce("new_label", "label").alias("label"))
    changed = before.join(labels.moved_counts(adj, moves), "id", "left").select("id", labels.changed_counts("counts", "changes").alias("counts"))
    want = labels.label_counts(labels.neigh_label_freq(adj, after))
    assert sorted(map(str, changed.collect())) == sorted(map(str, want.collect()))


def test_a_round_does_not_shuffle_the_vertices(spark, hub_edges, sort_merge_only):
    store = Store(spark, "round-test")
    adj = graph.weighted_adjacency(hub_edges)
    state = graph.vertices(hub_edges).select("id", (F.col("id") % 3).cast("int").alias("label"), F.lit(1.0).alias("score"))
    rows = state.join(labels.label_counts(labels.neigh_label_freq(adj, state)), "id")
    rows = store.save_bucketed(rows, "vertices", ["id"])
    moves = rows.where("id % 7 = 0").select("id", F.col("label").alias("old_label"), F.lit(0).alias("new_label"))
    nxt = rows.join(labels.moved_counts(adj, moves), "id", "left").withColumn("counts", labels.changed_counts("counts", "changes"))
    scored = labels.propose(labels.with_candidates(labels.scores_of_counts(nxt, {0: 0.5, 1: 0.9, 2: 1.1}, 1.0), 2.0, 0.5), ("counts",))
    assert not exchanges_below(scored._jdf.queryExecution().executedPlan().toString(), store.tables["vertices"])


def test_fewer_and_fewer_move(spark, hub_edges):
    out = partition.partition_with_core(hub_edges, 3, 0.05, max_rounds=6, seed=3, affinity="ratio", tol=0.0)
    moved = [r["moved"] for r in out.report]
    assert moved[0] > moved[-1] and out.state.count() == graph.vertices(hub_edges).count()


def test_routing_looks_the_edges_up_once(spark, hub_edges, monkeypatch):
    """One look-up per end of all edges; after it only edges with an open end are joined."""
    looked = []
    real = graph.lookup

    def counted(rows, key, *rest, **named):
        looked.append((key, rows.count()))
        return real(rows, key, *rest, **named)

    monkeypatch.setattr(graph, "lookup", counted)
    monkeypatch.setattr(route, "lookup", counted)
    parts = graph.vertices(hub_edges).select("id", (F.col("id") % 4).cast("int").alias("part")).where("id % 10 <> 3")
    found = route.final_ends(hub_edges, parts, 3, 1)
    whole, open_edges = hub_edges.count(), graph.edge_parts(hub_edges, parts).where("src_part = -1 OR dst_part = -1").count()
    assert 0 < open_edges < whole
    assert [n for k, n in looked if k in ("src", "dst") and n == whole][:2] == [whole, whole]
    assert sum(n == whole for k, n in looked[:-2]) == 2
    assert found.ends.count() == whole
    again = graph.edge_parts(hub_edges, found.assignment)
    assert sorted(map(tuple, found.ends.collect())) == sorted(map(tuple, again.select(*found.ends.columns).collect()))
