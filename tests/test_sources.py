"""Reading and writing the text formats."""

import math
import os

import pytest
from pyspark.sql import functions as F

from corepart import sources
from corepart.operators import graph, route
from corepart.store import Store, checkpoint_root


@pytest.fixture
def folder(spark):
    return Store(spark, "test-sources")


def text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_clean_edges(spark):
    lines = ["1 2", "  3   4\t", "5\t6", "7 8 9", "a 1", "1.9 -2.9", "1e3 2", "NaN 1", "Infinity 1", "", "4", "# 1 2"]
    got = sorted(map(tuple, sources.clean_edges(text(spark, lines)).collect()))
    assert got == [(1, -2), (1, 2), (3, 4), (1000, 2)]


def test_edges_round_trip(spark, toy, folder):
    path = folder.path("edges")
    sources.write_edges(toy, path)
    back = sources.read_edges(spark, path, 3)
    assert back.exceptAll(toy).isEmpty() and toy.exceptAll(back).isEmpty()
    assert back.rdd.getNumPartitions() == 3


def test_edge_list_skips_comments_and_extra_tokens(spark):
    got = sources.parse_edges(text(spark, ["# 1 2", "1\t2 9", "", "3   4"])).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (3, 4)]


def test_line_index_over_file_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sources.line_index(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000
    assert all(r.value.split()[1] == str(r.id) for r in got)


def test_line_indexed_assignment_and_features(spark, tmp_path):
    (tmp_path / "parts").write_text("2\n0\n1\n")
    (tmp_path / "feats").write_text("1.0 2.5\n3 4\n-1e-3 0\n")
    a = sources.read_assignment(spark, str(tmp_path / "parts"), keyed=False)
    assert sorted(map(tuple, a.collect())) == [(0, 2), (1, 0), (2, 1)]
    f = {r.id: r.feat for r in sources.read_features(spark, str(tmp_path / "feats")).collect()}
    assert f == {0: [1.0, 2.5], 1: [3.0, 4.0], 2: [-0.001, 0.0]}


def test_keyed_assignment_reads_part_files_only(spark, tmp_path):
    (tmp_path / "part-0").write_text("1 0\n2 3\n")
    (tmp_path / "part-1").write_text("9 1\n")
    (tmp_path / "other").write_text("7 7\n")
    got = sources.read_assignment(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 3), (9, 1)]


def test_core_round_trip(spark, folder):
    path = folder.path("core")
    sources.write_core(spark.createDataFrame([(4,), (5,)], "id bigint"), path)
    assert sorted(map(tuple, sources.read_core(spark, path).collect())) == [(4, 0), (5, 0)]


def test_part_files_start_at_zero(spark, toy, folder):
    a = spark.createDataFrame([(v, 1 if v < 5 else 2) for v in range(1, 9)], "id bigint, part int")
    routed = route.route_edges(toy, a, 2).cache()
    path = folder.path("parts")
    sources.write_parts(routed, path)
    assert {r.file for r in spark.read.text(path).select("file").distinct().collect()} == {0, 1}
    back = sources.read_parts(spark, path)
    assert back.exceptAll(routed).isEmpty() and routed.exceptAll(back).isEmpty()


def test_part_features_hold_the_core_everywhere(spark, folder):
    feats = spark.createDataFrame([(i, [i / 3, -1.0]) for i in range(4)], "id bigint, feat array<double>")
    a = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 1)], "id bigint, part int")
    path = folder.path("feats")
    sources.write_part_features(route.part_features(feats, a, 2), path)
    got = sources.parse_embeddings(spark.read.text(path)).collect()
    assert sorted((r.file, r.id) for r in got) == [(0, 0), (0, 1), (0, 3), (1, 0), (1, 2)]
    assert {r.id: r.vec for r in got}[1] == [1 / 3, -1.0]


def test_embedding_lines(spark):
    got = sources.parse_embeddings(text(spark, ["7   1.5  -2e-3 \t", "", "8 0 1"])).collect()
    assert {r.id: r.vec for r in got} == {7: [1.5, -0.002], 8: [0.0, 1.0]}
    emb = spark.createDataFrame([(1, [math.pi, 1e-17])], "id bigint, vec array<double>")
    assert sources.parse_embeddings(sources.format_embeddings(emb)).first().vec == [math.pi, 1e-17]


def test_adjacency_lines(toy):
    lines = [r.line for r in graph.adjacency_lines(toy).orderBy("line_no").collect()]
    assert lines == ["8 9 000", "2 3 4", "1 3", "1 2", "1 5 6", "4 6", "4 5 7", "6 8", "7"]


def test_event_log(spark):
    def line(event, *metrics):
        body = ",".join(f'{{"Name":"internal.metrics.{n}","Value":{v}}}' for n, v in metrics)
        return f'{{"Event":"{event}","Accumulables":[{body}]}}'

    log = text(
        spark,
        [
            line("SparkListenerStageCompleted", ("shuffle.read.remoteBytesRead", 10**9), ("resultSize", 500)),
            line("SparkListenerStageCompleted", ("resultSize", 1500)),
            line("SparkListenerTaskEnd", ("resultSize", 99)),
        ],
    )
    assert sorted((r[0] or 0, r[1]) for r in sources.stage_bytes(log).collect()) == [(0, 1500), (10**9, 500)]
    assert sources.shuffle_bytes(log).first().total_gb == pytest.approx(1.000002)


def test_manifest(spark):
    got = sources.part_manifest(spark, 2, "d/parts/", 2).orderBy("part").collect()
    assert [tuple(r) for r in got] == [(1, "d/parts/file=0", 2), (2, "d/parts/file=1", 2)]


def test_store_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == folder
    store = Store(spark, "x")
    store.save(spark.range(3), "t")
    assert store.root.startswith(f"{folder}/x-")
    assert store.complete("t") and store.read("t").count() == 3
    store.drop("t")
    assert not store.complete("t")


def test_features_reach_the_scan(spark, folder):
    path = folder.path("wide")
    spark.range(10).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("x").alias("other")).write.parquet(path)
    plan = graph.degrees(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<src:bigint,dst:bigint>" in plan


def test_named_part_files(spark, folder):
    edges = spark.createDataFrame([(1, 5, 6), (1, 1, 2), (1, 1, 2), (3, 9, 9)], "part int, src bigint, dst bigint")
    path = folder.path("named")
    sources.write_named_parts(edges, path, parts=4)
    assert {f for f in os.listdir(path) if f[0] not in "._"} == {f"part_{k}.txt" for k in range(4)}
    with open(f"{path}/part_0.txt") as f:
        assert f.read() == "1 2\n1 2\n5 6\n"  # in order
    assert os.path.getsize(f"{path}/part_1.txt") == 0
    back = sorted(map(tuple, sources.read_named_parts(spark, path).collect()))
    assert back == [(1, 1, 2), (1, 1, 2), (1, 5, 6), (3, 9, 9)]
    sources.write_named_parts(edges.where("part = 1 AND src = 5"), path, parts=1)  # a repeated run replaces files
    assert sorted(map(tuple, sources.read_named_parts(spark, path).collect())) == [(1, 5, 6), (3, 9, 9)]
    feats = spark.createDataFrame([(1, 2, [0.5, 1.0]), (1, 1, [2.0, -1.0])], "part int, id bigint, feat array<double>")
    sources.write_named_features(feats, path)
    with open(f"{path}/part_0.txt.feat") as f:
        assert f.read() == "1 2.0 -1.0\n2 0.5 1.0\n"
    assert sorted(map(tuple, sources.read_named_features(spark, path).collect())) == [(1, 1, [2.0, -1.0]), (1, 2, [0.5, 1.0])]
    assert sources.read_named_parts(spark, path).count() == 2  # features are no edges


def test_a_hub_line_is_streamed_in_pieces(spark, folder):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(5, 6)], "src bigint, dst bigint")
    pieces = graph.adjacency_pieces(edges, piece=16)
    assert pieces.selectExpr("max(size(split(value, ' ')))").first()[0] <= 16
    assert pieces.where("line_no = 1").count() >= 299 // 16
    path = folder.path("adjacency")
    graph.write_adjacency(edges, path, piece=16)
    text = ""
    for name in sorted(n for n in os.listdir(path) if n.startswith("part-")):
        with open(f"{path}/{name}") as f:
            text += f.read()
    want = [r.line for r in graph.adjacency_lines(edges).orderBy("line_no").collect()]
    assert [line.strip() for line in text.split("\n")] == want
    assert sorted(r.line for r in graph.read_adjacency(spark, path).collect()) == sorted(want)
