"""The hand-checked eight-vertex graph: degrees, seed, scores, proposals, routing."""

import pytest
from pyspark.sql import functions as F
from toy import TOY_LABELS

from corepart.operators import graph, labels, route
from corepart.plans import partition

DEGREES = {1: 4, 2: 3, 3: 2, 4: 3, 5: 2, 6: 3, 7: 2, 8: 3}


@pytest.fixture(scope="module")
def state(spark):
    rows = [(v, p, float(DEGREES[v])) for v, p in TOY_LABELS.items()]
    return spark.createDataFrame(rows, "id bigint, label int, score double").cache()


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_degrees(toy):
    assert as_dict(graph.degrees(toy), "id", "degree") == DEGREES


def test_counts(toy):
    r = graph.graph_counts(toy).first()
    assert (r.n_vertices, r.n_edges) == (8, 11)


def test_seed_core_takes_all_ties(toy):
    seeded, threshold, n = partition.seed_core(toy, 2, 0.125, "degree", seed=1)
    assert (threshold, n) == (3.0, 8)
    assert {r.id for r in seeded.where("label = 0").collect()} == {1, 2, 4, 6, 8}
    assert all(r.label in (1, 2) for r in seeded.where("label <> 0").collect())


def test_capacity_and_load(state):
    caps = labels.capacity(8, 2, 1.05, 0.125)
    assert caps[0] == pytest.approx(1.05) and caps[1] == caps[2] == pytest.approx(3.675)
    sizes = labels.part_size(state)
    assert as_dict(sizes, "label", "size") == {0: 1, 1: 3, 2: 4}
    load = as_dict(labels.part_load(sizes, caps), "label", "load")
    assert load == pytest.approx({0: 0.952381, 1: 0.816327, 2: 1.088435}, abs=1e-6)


def test_cuts(toy, state):
    r = route.edge_cut(graph.triplets(toy, state, "label")).first()
    assert (r.cut_real, r.cut_all) == (2, 6)


def test_neighbour_labels(toy, state):
    freq = labels.neigh_label_freq(graph.adjacency(toy), state)
    got = {}
    for r in freq.collect():
        got.setdefault(r.id, {})[r.label] = r.cnt
    assert got == {
        1: {1: 3, 2: 1},
        2: {0: 2, 1: 1},
        3: {0: 1, 1: 1},
        4: {0: 1, 2: 2},
        5: {2: 2},
        6: {1: 1, 2: 2},
        7: {2: 2},
        8: {1: 1, 2: 2},
    }


PROPOSALS = {
    "floor": {
        1: (1, 0.183673), 2: (1, 0.183673), 3: (1, 0.183673), 4: (0, 0.047619),
        5: (2, 0.911565), 6: (1, 0.183673), 7: (2, 0.911565), 8: (1, 0.183673),
    },
    "ratio": {
        1: (1, 0.933673), 2: (0, 0.714286), 3: (1, 0.683673), 4: (2, 0.578231),
        5: (2, 0.911565), 6: (2, 0.578231), 7: (2, 0.911565), 8: (2, 0.578231),
    },
}
OBJECTIVE = {"floor": 2.789116, "ratio": 5.889456}
DEMAND = {"floor": {0: 1, 1: 3, 2: 1}, "ratio": {0: 1, 1: 1, 2: 1}}
PROB = {"floor": {0: 0.05, 1: 0.225, 2: -0.325}, "ratio": {0: 0.05, 1: 0.675, 2: -0.325}}


@pytest.mark.parametrize("affinity", ["floor", "ratio"])
def test_round(toy, state, affinity):
    caps = labels.capacity(8, 2, 1.05, 0.125)
    sizes = labels.part_size(state)
    freq = labels.neigh_label_freq(graph.weighted_adjacency(toy), state)
    scored = labels.label_scores(freq, labels.part_load(sizes, caps), 1.0, affinity)
    proposal = labels.propose(labels.core_candidate(scored, state, 3.0, 0.5)).cache()
    rows = {r.id: r for r in proposal.collect()}
    for v, (label, best) in PROPOSALS[affinity].items():
        assert rows[v].new_label == label, v
        assert rows[v].best == pytest.approx(best, abs=2e-6)
    assert labels.objective(proposal).first().objective == pytest.approx(OBJECTIVE[affinity], abs=5e-6)
    assert sum(r.cut_all for r in rows.values()) == 2 * 6
    assert sum(r.cut_real for r in rows.values()) == 2 * 2
    wanted = labels.demand(proposal)
    assert as_dict(wanted, "label", "demand") == DEMAND[affinity]
    prob = as_dict(labels.migration_prob(sizes, wanted, caps), "label", "prob")
    assert prob == pytest.approx(PROB[affinity], abs=1e-9)
    moved = {r.id: r.label for r in labels.migrate(proposal, prob, "1:migrate:1").collect()}
    for v, r in rows.items():
        assert moved[v] in (r.old_label, r.new_label)
        if r.old_label == r.new_label or prob[r.new_label] <= 0:
            assert moved[v] == r.old_label


def lines(df):
    return sorted((r.part, r.src, r.dst) for r in df.collect())


def test_routing(toy, state):
    a = state.select("id", F.col("label").alias("part"))
    routed = lines(route.route_edges(toy, a, 2))
    one = [(1, 1, 2), (1, 1, 2), (1, 1, 3), (1, 2, 3)]
    two = [(2, 1, 4), (2, 4, 5), (2, 4, 6), (2, 5, 6), (2, 8, 8)]
    assert routed == sorted(one + two)


def test_routing_with_seed_labels(spark, toy):
    a = spark.createDataFrame([(v, 0 if v in (1, 2, 4, 6, 8) else 2) for v in range(1, 9)], "id bigint, part int")
    routed = lines(route.route_edges(toy, a, 2))
    assert [r for r in routed if r[0] == 1] == [(1, 1, 2), (1, 1, 2), (1, 1, 4), (1, 4, 6), (1, 8, 8)]
    assert len([r for r in routed if r[0] == 2]) == 11


def test_progress():
    assert labels.progress(2.0, 4.0) == 0.5
    assert labels.progress(2.0, 0.0) == float("inf")
    assert labels.progress(0.0, 0.0) != labels.progress(0.0, 0.0)
