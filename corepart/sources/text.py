"""Readers and writers. Parsing functions take a DataFrame with a `value STRING` column."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.operators.order import running_total
from corepart.store import Store


def _stripped(c: str = "value") -> Column:
    # all leading and trailing whitespace and control characters, not spaces only
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _fields(pattern: str) -> Column:
    return F.split(_stripped(), pattern)


def clean_edges(lines: DataFrame) -> DataFrame:
    """(src, dst): lines of exactly two numbers separated by spaces (tabs do not separate).

    Numbers are truncated toward zero. Numbers that do not fit a BIGINT (NaN, Infinity) are dropped.
    """
    t = F.col("t")
    number = [t[i].try_cast("double") for i in (0, 1)]
    src, dst = [n.try_cast("bigint") for n in number]
    return (
        lines.select(_fields(" +").alias("t"))
        .where(F.size("t") == 2)
        .select(src.alias("src"), dst.alias("dst"))
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    )


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "src", "dst").alias("value"))


def write_edges(edges: DataFrame, path: str) -> None:
    """One `src dst` line per edge; also used for the edges outside the core."""
    edge_lines(edges).write.text(path)


def parse_edges(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, src, dst): first two whitespace-separated tokens; lines that start with # are skipped."""
    kept = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    t = F.col("t")
    return kept.select(*keep, _fields(r"\s+").alias("t")).select(
        *keep, t[0].cast("bigint").alias("src"), t[1].cast("bigint").alias("dst")
    )


def read_edges(spark: SparkSession, path: str, n_parts: int | None = None) -> DataFrame:
    """Edges in their stored direction, spread over at least `n_parts` partitions if given."""
    edges = parse_edges(spark.read.text(path))
    return edges.repartition(n_parts) if n_parts else edges


def line_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): every line of the file(s) with its 0-based line number.

    Lines keep their order inside a file split, and splits are ordered by file and offset, so
    only one small row per split is sorted.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("mid"),
    )
    lines = Store(spark, "line-index").save(lines, "lines")
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    ordered = running_total(splits, ["file", "start"], "n")
    # a split has one row here and a bounded number of lines there
    return lines.join(ordered, ["file", "start"]).select(
        (F.col("upto") - F.col("n") + F.col("mid") - F.col("first")).alias("id"), "value"
    )


def parse_assignment(lines: DataFrame) -> DataFrame:
    """(id, part) from `id part` lines."""
    t = F.col("t")
    return lines.select(_fields(r"\s+").alias("t")).select(
        t[0].cast("bigint").alias("id"), t[1].cast("int").alias("part")
    )


def read_assignment(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """Keyed: the `part*` files of a directory. Otherwise the line number is the id."""
    if keyed:
        files = spark.read.option("pathGlobFilter", "part*").text(path)
        return parse_assignment(files)
    return line_index(spark, path).select("id", _stripped().cast("int").alias("part"))


def read_core(spark: SparkSession, path: str) -> DataFrame:
    return parse_assignment(spark.read.text(path)).select("id", F.lit(0).alias("part"))


def parse_features(lines: DataFrame) -> DataFrame:
    """(id, feat) from numbered lines (id, value) of floats."""
    return lines.select("id", _fields(r"\s+").cast("array<double>").alias("feat"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return parse_features(line_index(spark, path))


def parse_embeddings(lines: DataFrame) -> DataFrame:
    """(id, vec) from `id v1 … vd` lines, any run of spaces, trailing whitespace allowed."""
    keep = [c for c in lines.columns if c != "value"]
    t = F.col("t")
    vec = F.slice(t, 2, F.size(t)).cast("array<double>")
    return (
        lines.where(_stripped() != "")
        .select(*keep, _fields(" +").alias("t"))
        .select(*keep, t[0].cast("bigint").alias("id"), vec.alias("vec"))
    )


def format_embeddings(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(value): `id v1 … vd` lines."""
    return df.select(
        F.concat_ws(" ", F.col("id").cast("string"), F.col(vec).cast("array<string>")).alias("value")
    )


def write_core(core: DataFrame, path: str) -> None:
    """One `id 0` line per core vertex. The core grows with the graph, so it is not one file."""
    core.select(F.concat_ws(" ", "id", F.lit("0")).alias("value")).write.text(path)


def _write_by_part(df: DataFrame, path: str) -> None:
    # a rebalance by part gives few files per part and still splits a part that holds most rows
    df.hint("rebalance", "file").write.partitionBy("file").text(path)


def write_parts(part_edges: DataFrame, path: str, first_part: int = 1) -> None:
    """`src dst` lines, one directory `file=k` per part; file 0 is part `first_part`."""
    line = F.concat_ws(" ", "src", "dst").alias("value")
    _write_by_part(part_edges.select((F.col("part") - first_part).alias("file"), line), path)


def write_part_features(part_feats: DataFrame, path: str, first_part: int = 1) -> None:
    """`id f1 … fd` lines, one directory `file=k` per part; file 0 is part `first_part`."""
    line = F.concat_ws(" ", F.col("id").cast("string"), F.col("feat").cast("array<string>")).alias("value")
    _write_by_part(part_feats.select((F.col("part") - first_part).alias("file"), line), path)


def _write_named(rows: DataFrame, path: str, suffix: str, order: list[str], parts: int | None) -> None:
    """One file `part_<file>.txt<suffix>` per value of `file`, its lines in `order`.

    A file is streamed by one task, in sorted order. The files are written under a folder of their own
    and get their names only after all of them are complete; a run that dies before leaves no
    named file, and a repeated run replaces them. With `parts` the files 0 .. parts - 1 are all made, also empty ones.
    """
    spark = rows.sparkSession
    store = Store(spark, "named", f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}")
    sorted_rows = rows.repartitionByRange("file", F.lit(0)).sortWithinPartitions("file", *order)
    sorted_rows.select("file", "value").write.partitionBy("file").text(store.root)
    fs, root, jvm = store._hadoop("")
    made = set()
    for folder in store.names():
        if folder.startswith("file="):
            k = int(folder.removeprefix("file="))
            (name,) = [n for n in store.names(folder) if n.startswith("part-")]
            target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part_{k}.txt{suffix}")
            fs.delete(target, False)
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(store.path(f"{folder}/{name}")), target):
                raise OSError(f"could not name {target}")
            made.add(k)
    for k in set(range(parts or 0)) - made:
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part_{k}.txt{suffix}"), True).close()
    fs.delete(root, True)


def write_named_parts(part_edges: DataFrame, path: str, first_part: int = 1, parts: int | None = None) -> None:
    """`src dst` lines in `path`/part_0.txt, part_1.txt, ...: the files that a part's trainer is given."""
    line = F.concat_ws(" ", "src", "dst").alias("value")
    _write_named(part_edges.select((F.col("part") - first_part).alias("file"), "src", "dst", line), path, "", ["src", "dst"], parts)


def write_named_features(part_feats: DataFrame, path: str, first_part: int = 1, parts: int | None = None) -> None:
    """`id f1 … fd` lines in `path`/part_0.txt.feat, part_1.txt.feat, ..."""
    line = F.concat_ws(" ", F.col("id").cast("string"), F.col("feat").cast("array<string>")).alias("value")
    _write_named(part_feats.select((F.col("part") - first_part).alias("file"), "id", line), path, ".feat", ["id"], parts)


def _read_named(spark: SparkSession, path: str, suffix: str, first_part: int) -> DataFrame:
    lines = spark.read.text(f"{path.rstrip('/')}/part_*.txt{suffix}")  # nothing below, such as folders of parts
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part_(\d+)\.txt", 1).cast("int")
    return lines.select((number + first_part).alias("part"), "value")


def read_named_parts(spark: SparkSession, path: str, first_part: int = 1) -> DataFrame:
    """(part, src, dst) written by write_named_parts."""
    t = F.split("value", " ")
    return _read_named(spark, path, "", first_part).select("part", t[0].cast("bigint").alias("src"), t[1].cast("bigint").alias("dst"))


def read_named_features(spark: SparkSession, path: str, first_part: int = 1) -> DataFrame:
    """(part, id, feat) written by write_named_features."""
    rows = parse_embeddings(_read_named(spark, path, ".feat", first_part))
    return rows.withColumnRenamed("vec", "feat")


def named_manifest(spark: SparkSession, parts: int, path: str, epoch: int | None = None) -> DataFrame:
    """(part, path[, epoch]): the file of each part 1 .. `parts`."""
    part = F.col("id").cast("int")
    out = spark.range(1, parts + 1).select(part.alias("part"), F.format_string(f"{path.rstrip('/')}/part_%d.txt", part - 1).alias("path"))
    return out if epoch is None else out.withColumn("epoch", F.lit(epoch))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, src, dst) written by write_parts; the part is the file number plus one."""
    t = F.split("value", " ")
    return spark.read.text(path).select(
        (F.col("file") + 1).cast("int").alias("part"),
        t[0].cast("bigint").alias("src"),
        t[1].cast("bigint").alias("dst"),
    )


def part_manifest(spark: SparkSession, parts: int, path: str, epoch: int | None = None) -> DataFrame:
    """(part, path[, epoch]): where `write_parts` put the edges of parts 1 .. `parts`.

    A part without edges has no folder, so readers should allow for a missing path.
    """
    part = F.col("id").cast("int")
    file = F.concat(F.lit(path.rstrip("/") + "/file="), (part - 1).cast("string"))
    out = spark.range(1, parts + 1).select(part.alias("part"), file.alias("path"))
    return out if epoch is None else out.withColumn("epoch", F.lit(epoch))
