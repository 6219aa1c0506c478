"""The command-line jobs, chained from raw lines to aligned embeddings."""

import pytest
from pyspark.sql import functions as F

from corepart import jobs, sources
from corepart.operators import graph
from corepart.plans import split


@pytest.fixture(scope="module")
def work(spark, hub_edges, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    lines = hub_edges.select(F.concat_ws("  ", "src", "dst").alias("value"))
    lines.unionByName(spark.createDataFrame([("x 1",), ("1 2 3",)], "value string")).write.text(f"{root}/raw")
    jobs.main(["clean", f"{root}/raw", f"{root}/edges"], spark)
    return root


def run(spark, work, *words):
    jobs.main(["--seed", "3", *(w.replace("@", f"{work}/") for w in words)], spark)


def test_clean(spark, work, hub_edges):
    assert sources.read_edges(spark, f"{work}/edges").count() == hub_edges.count()


def test_core_split_embed(spark, work, hub_edges, capsys):
    loop = ["--parts", "2", "--max-rounds", "2", "--affinity", "ratio"]
    run(spark, work, "core", "@edges", "@core", "@rest", "--core-rate", "0.05", *loop)
    core = sources.read_core(spark, f"{work}/core")
    assert 0 < core.count() < 60
    assert graph.restrict(graph.vertices(sources.read_edges(spark, f"{work}/rest")), core).isEmpty()
    run(spark, work, "split", "@edges", "@core", "@split", *loop)
    edges = sources.read_parts(spark, f"{work}/split/edges")
    assert {r.part for r in edges.select("part").distinct().collect()} == {1, 2}
    run(
        spark, work, "embed", "@split/edges", "@emb", "--parts", "2", "--dim", "4", "--batch-size", "5000",
        "--state", "@state",
    )
    emb = sources.parse_embeddings(spark.read.text(f"{work}/emb"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    assert emb.where(F.size("vec") == 4).select("id").distinct().count() == ids.count()
    assert "core:" in capsys.readouterr().out


def test_partition_and_plain(spark, work):
    run(spark, work, "partition", "@edges", "@parts", "--parts", "2", "--core-rate", "0.05", "--max-rounds", "1")
    assert not sources.read_parts(spark, f"{work}/parts").isEmpty()
    run(spark, work, "partition-plain", "@edges", "@plain", "--parts", "2", "--max-rounds", "1")
    run(spark, work, "connectivity", "@edges", "@plain")
    run(spark, work, "route", "@edges", "@plain", "@routed", "--parts", "1")
    run(spark, work, "degrees", "@edges", "--top", "3")
    assert sources.read_assignment(spark, f"{work}/plain").count() == graph.vertices(sources.read_edges(spark, f"{work}/edges")).count()


def test_split_reports_every_edge(hub_edges):
    core = graph.grow_core(hub_edges, 20, 1)
    done = split.split_graph(hub_edges, core, 3, max_rounds=2)
    inner = graph.induced(hub_edges, core).count()
    assert done.part_edges.count() + done.report["cut"] == hub_edges.count() + 2 * inner
    assert done.report["core"] == 20
    assert done.assignment.count() == done.assignment.select("id").distinct().count()


def test_grow_writes_the_simple_graph_of_each_part(spark, work, capsys):
    run(spark, work, "grow", "@edges", "@grown", "--parts", "2", "--max-rounds", "2", "--core-size", "20", "--named")
    assert "'core': 20" in capsys.readouterr().out
    folders, files = sources.read_parts(spark, f"{work}/grown/edges"), sources.read_named_parts(spark, f"{work}/grown")
    assert sorted(map(tuple, folders.collect())) == sorted(map(tuple, files.collect()))
    assert files.where("src > dst").isEmpty() and files.distinct().count() == files.count() > 0
