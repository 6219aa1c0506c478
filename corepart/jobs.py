"""Command line: python -m corepart.jobs <job> … (see --help of each job)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corepart import sources
from corepart.operators import graph, route
from corepart.operators.skew import find_hubs
from corepart.plans import embed, partition, split
from corepart.session import builder


def _loop_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--parts", type=int, required=True)
    p.add_argument("--slack", type=float, default=1.05)
    p.add_argument("--lam-edge", type=float, default=1.0)
    p.add_argument("--tol", type=float, default=1e-3)
    p.add_argument("--max-rounds", type=int, default=20)
    p.add_argument("--affinity", choices=["floor", "ratio"], default="floor")


def _core_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--core-rate", type=float, required=True)
    p.add_argument("--strategy", default="degree", help="pagerank, degree, or anything else for random")
    p.add_argument("--lam-rank", type=float, default=0.5)


def _file_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--feats")
    p.add_argument("--named", action="store_true", help="also write part_0.txt, part_1.txt, … and their .feat files")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corepart.jobs")
    top.add_argument("--seed", type=int, default=0)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=text)
        for path in paths:
            p.add_argument(path)
        return p

    job("clean", "keep the valid lines of a raw edge list", "edges", "out")
    p = job("core", "find the core; write core vertices and the edges outside it", "edges", "core_out", "edges_out")
    _loop_arguments(p)
    _core_arguments(p)
    p = job("partition", "label propagation with a core; write part edge files", "edges", "out")
    _loop_arguments(p)
    _core_arguments(p)
    _loop_arguments(job("partition-plain", "label propagation without a core; write `id part` lines", "edges", "out"))
    p = job("split", "partition the graph outside a core file and write part files", "edges", "core", "out")
    _loop_arguments(p)
    _file_arguments(p)
    p = job("grow", "grow a random core of a given size, then split; a part is the simple graph inside part and core", "edges", "out")
    _loop_arguments(p)
    p.add_argument("--core-size", type=int, required=True)
    _file_arguments(p)
    p = job("route", "write part files for a given `id part` assignment", "edges", "assignment", "out")
    p.add_argument("--parts", type=int, required=True)
    p.add_argument("--lines", action="store_true", help="the assignment has one part per line, line number = id")
    _file_arguments(p)
    p = job("route-plain", "write part files without a core for a line-indexed assignment", "edges", "assignment", "out")
    p.add_argument("--feats")
    p = job("embed", "train every part, align the parts, write `id v1 … vd` lines", "parts_dir", "out")
    p.add_argument("--parts", type=int, required=True)
    p.add_argument("--method", choices=["walks", "edges", "sage", "sage_walks"], default="walks")
    p.add_argument("--feats")
    p.add_argument("--dim", type=int, default=128)
    p.add_argument("--epochs", type=int, default=1)
    p.add_argument("--batch-size", type=int, default=2000)
    p.add_argument("--walk-length", type=int, default=4)
    p.add_argument("--context", type=int, default=2)
    p.add_argument("--p", type=float, default=1.0)
    p.add_argument("--q", type=float, default=1.0)
    p.add_argument("--ridge", type=float, default=0.0)
    p.add_argument("--dedupe", action="store_true", help="one vector for a core vertex that is missing in some part")
    p.add_argument("--state", help="folder for per-epoch state; a rerun continues there")
    job("degrees", "print the highest degrees and their share of the vertices", "edges").add_argument("--top", type=int, default=10)
    job("connectivity", "print the number of components in each part", "edges", "assignment")
    job("bytes", "print the bytes moved according to a Spark event log", "log")
    return top


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or builder(f"corepart-{a.job}").getOrCreate()
    if a.job == "clean":
        sources.write_edges(sources.clean_edges(spark.read.text(a.edges)), a.out)
        return
    if a.job == "bytes":
        sources.shuffle_bytes(spark.read.text(a.log)).show(truncate=False)
        return
    if a.job == "embed":
        feats = sources.read_features(spark, a.feats) if a.feats else None
        edges = sources.read_parts(spark, a.parts_dir)
        _, seconds = embed.embed_job(
            edges, a.parts, a.method, a.out, feats=feats, dim=a.dim, epochs=a.epochs,
            batch_size=a.batch_size, seed=a.seed, state_path=a.state,
            walk_length=a.walk_length, context=a.context, p=a.p, q=a.q, ridge=a.ridge, dedupe=a.dedupe,
        )
        print(f"seconds: {seconds:.1f}")
        return
    edges = sources.read_edges(spark, a.edges)
    if a.job == "degrees":
        graph.top_degree(edges, a.top).show(a.top)
    elif a.job == "connectivity":
        found = graph.components_by_part(edges, sources.read_assignment(spark, a.assignment), find_hubs(edges))
        for row in found.orderBy("part").toLocalIterator():  # one row per part
            print(row.part, row.n_components)
    elif a.job in ("core", "partition"):
        out = partition.partition_with_core(
            edges, a.parts, a.core_rate, a.slack, a.strategy, a.lam_edge, a.lam_rank,
            a.tol, a.max_rounds, a.seed, a.affinity,
        )
        for row in out.report:
            print(row)
        if a.job == "core":
            core = partition.extract_core(edges, out.state)
            print(f"core: {core.candidates} candidates, {core.kept} kept")
            sources.write_core(core.core, a.core_out)
            sources.write_edges(core.edges, a.edges_out)
        else:
            sources.write_parts(route.route_edges(edges, out.assignment(), a.parts, find_hubs(edges)), a.out)
    elif a.job == "partition-plain":
        out = partition.partition_plain(
            edges, a.parts, a.slack, a.lam_edge, a.tol, a.max_rounds, a.seed, a.affinity
        )
        for row in out.report:
            print(row)
        out.assignment().select(F.concat_ws(" ", "id", "part").alias("value")).write.text(a.out)
    elif a.job in ("split", "grow"):
        core = sources.read_core(spark, a.core) if a.job == "split" else graph.grow_core(edges, a.core_size, a.seed)
        done = split.split_graph(edges, core, a.parts, a.slack, a.tol, a.max_rounds, a.seed, a.affinity, a.lam_edge)
        if a.job == "grow":
            done.part_edges = route.part_with_core_edges(edges, done.assignment, a.parts, find_hubs(edges))
        done.write(a.out, sources.read_features(spark, a.feats) if a.feats else None, named=a.named)
        print(done.report)
    elif a.job == "route":
        assignment = sources.read_assignment(spark, a.assignment, keyed=not a.lines)
        done = split.route_split(edges, assignment, a.parts, a.seed)
        done.write(a.out, sources.read_features(spark, a.feats) if a.feats else None, named=a.named)
        print(done.report)
    else:
        assignment = sources.read_assignment(spark, a.assignment, keyed=False)
        sources.write_parts(split.split_plain(edges, assignment), f"{a.out}/edges", first_part=0)
        if a.feats:
            rows = route.part_features(sources.read_features(spark, a.feats), assignment)
            sources.write_part_features(rows, f"{a.out}/feats", first_part=0)


if __name__ == "__main__":
    main()
