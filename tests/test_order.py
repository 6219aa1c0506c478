"""Positions, running totals and weighted choice against brute force."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from corepart.functions import draw, draw_int
from corepart.operators import labels, walks
from corepart.operators.order import dense_index, running_total


def test_dense_index(spark):
    ids = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(7)
    got = {r.id: r.pos for r in dense_index(df, ["id"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.createDataFrame([], "id bigint"), ["id"]).count() == 0


def test_running_total(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(10**12)) for i in range(2000)]
    got = {r.id: r.upto for r in running_total(spark.createDataFrame(rows, "id bigint, w bigint"), ["id"], "w").collect()}
    assert got == dict(zip(range(2000), accumulate(w for _, w in rows)))


@pytest.mark.parametrize("k", [1, 10, 57, 200])
def test_threshold_is_the_kth_largest(spark, k):
    rnd = random.Random(3)
    scores = [float(rnd.randrange(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(scores)), "id bigint, score double")
    assert labels.core_threshold(df, k) == sorted(scores, reverse=True)[k - 1]


def test_weighted_choice_matches_a_linear_search(spark):
    rnd = random.Random(4)
    # one id holds a third of the weight, and one has none
    weights = [(0, 300.0), (1, 0.0)] + [(i, rnd.random() * 5) for i in range(2, 250)]
    us = [i / 1000 for i in range(1000)]
    w = spark.createDataFrame(weights, "id bigint, weight double")
    d = spark.createDataFrame(list(enumerate(us)), "n int, u double")
    got = {r.n: r.dst for r in walks.weighted_choice(d, w).collect()}
    whole = [(i, round(x * walks.WEIGHT_UNIT)) for i, x in weights]
    total = sum(x for _, x in whole)

    def find(u):
        t, at = int(u * total), 0
        for i, x in whole:
            at += x
            if t < at:
                return i

    assert got == {n: find(u) for n, u in enumerate(us)}
    assert 1 not in got.values()


def test_draw_is_uniform_and_repeatable(spark):
    df = spark.range(20_000)
    a = df.select(draw("id", salt="s").alias("u"))
    r = a.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01
    both = df.repartition(5).select("id", draw("id", salt="s").alias("u")).join(
        df.select("id", draw("id", salt="s").alias("w"), draw("id", salt="t").alias("x")), "id"
    )
    assert both.where("u <> w").isEmpty()
    assert abs(both.stat.corr("u", "x")) < 0.03
    parts = df.select(draw_int("id", salt="p", k=4, start=1).alias("p")).groupBy("p").count().collect()
    assert {p.p for p in parts} == {1, 2, 3, 4} and min(p["count"] for p in parts) > 4700


def test_running_total_of_signed_values_and_nulls(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, None if i % 7 == 0 else (5 if i % 2 else -4)) for i in range(400)]
        df = spark.createDataFrame(rows, "id bigint, w bigint").repartition(4)
        got = {r.id: r.upto for r in running_total(df, ["id"], "w").collect()}
        total = 0
        for i, w in rows:
            total += w or 0
            assert got[i] == total
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
