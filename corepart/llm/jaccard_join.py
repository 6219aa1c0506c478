"""Self-join of texts on the Jaccard similarity of their word shingles.

1. Identical texts are one node. A node has HASHES MinHash values and BANDS band keys.
2. Nodes that share a band key are compared in blocks of bounded size, a few MinHash values at
   a time; a pair is dropped as soon as the posterior probability that it reaches the threshold
   is below the tolerance. What is left of a block leaves it as a spanning forest.
3. The nodes connected by these forests are brought together once with all their shingles, in
   blocks again, and every pair that the MinHash values don't rule out is verified exactly.

No row is ever made for a pair: blocks return one row per member. A group of g near copies is
split into blocks of BLOCK members, so no task holds a group as a whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm import shingles
from corepart.llm.kept import kept
from corepart.llm.registry import query, table
from corepart.llm.saving import save_lean
from corepart.operators.graph import components
from corepart.store import Store

THRESHOLD = 0.8
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band with probability 5e-8
HASHES = BANDS * ROWS
STEP = 16  # MinHash values compared before each decision
TOLERANCE = 1e-6
BLOCK = 512
ARROW_ROWS = 1000  # rows a task gets at once
COLUMNS = 4096  # shingles in one slice of the incidence matrix
MULTIPLIERS = shingles.mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64)) | np.uint64(1)
OFFSETS = shingles.mix(np.arange(9001, 9001 + HASHES, dtype=np.uint64))


def fewest_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each step, the matches below which a pair is dropped.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), whose
    mass above t is the binomial probability of at most m successes in n + 1 trials.
    """

    def make() -> tuple[int, ...]:
        out = []
        for n in range(STEP, HASHES + 1, STEP):
            mass, m = 0.0, -1
            while mass < tolerance:
                m += 1
                mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            out.append(m)
        return tuple(out)

    return kept(("fewest", threshold, tolerance), make)


def minhashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of HASHES 32-bit minima for each text that has shingles."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    for j in range(HASHES if len(starts) else 0):
        out[:, j] = np.minimum.reduceat((hashes * MULTIPLIERS[j] + OFFSETS[j]) >> np.uint64(32), starts)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, digest, sig); sig is null without words."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo, hi, hashes, offsets in shingles.blocks(texts):
            rows = iter(minhashes(hashes, offsets))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(
                        [hashlib.sha256((t.as_py() or "").encode()).digest() for t in texts.slice(lo, hi - lo)],
                        pa.binary(),
                    ),
                    pa.array([next(rows).tobytes() if n else None for n in np.diff(offsets)], pa.binary()),
                ],
                ["doc_id", "digest", "sig"],
            )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig) to one row (key, node) per band."""
    band = shingles.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    weight = shingles.WEIGHTS[:ROWS]
    for batch in batches:
        node = np.asarray(batch.column(0))
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        keys = shingles.mix((sig.astype(np.uint64) * weight).sum(2, dtype=np.uint64) + band).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node, BANDS))], ["key", "node"])


def in_blocks(members: DataFrame, key: str, size: str, *columns: str) -> DataFrame:
    """Deal the members of each group to units (key, a, b) of two blocks, a <= b.

    A group of up to BLOCK members is one unit. A larger one has a unit for each two blocks, and
    each member is copied to all units of its block. Column `own` tells the member's block.
    """
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n.cast("bigint")).cast("int")
    return (
        members.withColumn("n_blocks", n)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "n_blocks", *columns)
        .repartition(key, "a", "b")
        .sortWithinPartitions(key, "a", "b", "own", "node")
    )


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit (the first three columns), sorted rows coming in any batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(j)).astype(np.int64) for j in range(3)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and tuple(keys[lo]) != last:
                yield _joined(held)
                held = []
            last = tuple(keys[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all rows; its strings have 64-bit offsets, since 2 GiB of text would be split."""
    if len(parts) == 1:
        return parts[0]
    wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    rows = pa.Table.from_batches(parts)
    rows = rows.cast(pa.schema([f.with_type(wide.get(f.type, f.type)) for f in rows.schema]))
    (batch,) = rows.combine_chunks().to_batches()
    return batch


def likely_pairs(sig: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of a block that the MinHash values don't rule out, step by step."""
    fewest = fewest_matches(threshold, tolerance)
    left, right = [], []
    for i in range(len(sig) - 1):
        others = np.arange(i + 1, len(sig))
        matches = np.zeros(len(others), np.int64)
        for step, least in enumerate(fewest):
            cut = slice(step * STEP, (step + 1) * STEP)
            matches += (sig[others, cut] == sig[i, cut]).sum(1)
            keep = matches >= least
            others, matches = others[keep], matches[keep]
            if not len(others):
                break
        left.append(np.full(len(others), i))
        right.append(others)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member that each of n members is connected to."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of every two sets, by slices of the incidence matrix."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    member, column = member[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    total = int(shared.sum())
    for lo in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, total - lo)), np.float32)
        part[member[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def signature_table(docs: DataFrame) -> DataFrame:
    """(digest, sig, first_doc, copies): one row per distinct text; null is an empty text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = rows.mapInArrow(_signed, "doc_id bigint, digest binary, sig binary")
    return signed.groupBy("digest").agg(
        F.first("sig").alias("sig"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")
    )


def likely_links(nodes: DataFrame, store: Store, threshold: float, tolerance: float) -> DataFrame:
    """(src, dst): a spanning forest of the pairs left in each block of a band's bucket."""
    sigs = nodes.where(F.col("sig").isNotNull()).select("node", "sig")
    bands = save_lean(store, sigs.mapInArrow(_banded, "key bigint, node bigint"), "bands", ARROW_ROWS)
    buckets = bands.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")
    )
    # Many bands have the same members: one bucket stands for all of them.
    buckets = buckets.where("n > 1").groupBy("n", "least", "members").agg(F.min("key").alias("key"))
    members = bands.join(buckets.select("key", "n"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            node, at = np.unique(np.asarray(unit.column("node")), return_index=True)
            sig = np.frombuffer(b"".join(unit.column("sig").take(pa.array(at)).to_pylist()), np.uint32)
            root = roots(len(node), *likely_pairs(sig.reshape(-1, HASHES), threshold, tolerance))
            tied = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[tied]]), pa.array(node[tied])], ["src", "dst"])

    dealt = in_blocks(members.join(sigs, "node"), "key", "n", "node", "sig")
    return dealt.mapInArrow(compare, "src bigint, dst bigint").distinct()


def verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, root, links, n_blocks) of each unit: true links of a node, and the least node they lead to."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = groups.join(sizes, "component").join(
        nodes.select(F.col("node").alias("id"), "sig", F.col("digest").alias("d"), "first_doc"), "id"
    )
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    )
    members = texts.join(
        wanted, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))
    ).select("component", "n", F.col("id").alias("node"), "sig", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            node, at = np.unique(np.asarray(unit.column("node")), return_index=True)
            unit = unit.take(pa.array(at))  # a repeated row comes more than once
            own, sig = np.asarray(unit.column("own")), np.frombuffer(b"".join(unit.column("sig").to_pylist()), np.uint32)
            left, right = likely_pairs(sig.reshape(-1, HASHES), threshold, tolerance)
            if int(unit.column(1)[0].as_py()) != int(unit.column(2)[0].as_py()):
                across = own[left] != own[right]  # pairs within a block belong to its own unit
                left, right = left[across], right[across]
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            if len(left):
                sets = []
                for lo, hi, hashes, offsets in shingles.blocks(unit.column("text")):
                    sets += [np.unique(hashes[offsets[i] : offsets[i + 1]]) for i in range(hi - lo)]
                size = np.array([len(s) for s in sets])
                if len(left) <= 2 * len(node):
                    common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)])
                else:
                    common = overlaps(sets)[left, right].astype(np.int64)
                true = common >= threshold * (size[left] + size[right] - common) - 1e-9
                left, right = left[true], right[true]
                links = np.bincount(left, minlength=len(node)) + np.bincount(right, minlength=len(node))
                root = roots(len(node), left, right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(node[root]), pa.array(links), unit.column("n_blocks")],
                ["node", "root", "links", "n_blocks"],
            )

    dealt = in_blocks(members, "component", "n", "node", "sig", "text")
    return dealt.mapInArrow(verify, "node bigint, root bigint, links bigint, n_blocks int")


def jaccard_classes(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, store: Store | None = None
) -> DataFrame:
    """(digest, first_doc, copies, n_links, class_id, root): one row per distinct text.

    n_links counts the other distinct texts with a similarity of at least the threshold.
    class_id is the least doc_id of all texts that links connect, and root tells classes apart
    whose ids are null. Texts without words, and null ones, link to nothing; a text of one to
    four words equals only one of the same words.
    """
    store = store or Store(docs.sparkSession, "jaccard-join")
    nodes = save_lean(store, signature_table(docs).withColumn("node", F.monotonically_increasing_id()), "nodes", ARROW_ROWS)
    forest = save_lean(store, likely_links(nodes, store, threshold, tolerance), "forest", ARROW_ROWS)
    store.drop("bands")
    ends = forest.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    groups = save_lean(store, components(ends, forest), "groups")
    found = save_lean(store, verified(docs, nodes, groups, threshold, tolerance), "found", ARROW_ROWS)
    whole = found.where("n_blocks = 1").select("node", "root", "links")
    parts = found.where("n_blocks > 1")
    tied = save_lean(store, parts.where("node <> root").select(F.col("root").alias("src"), F.col("node").alias("dst")).distinct(), "tied")
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"))
    if not tied.isEmpty():
        joined = components(counts.select(F.col("node").alias("id")), tied)
        counts = counts.join(joined.withColumnRenamed("id", "node").withColumnRenamed("component", "root"), "node")
    else:
        counts = counts.withColumn("root", F.col("node"))
    placed = save_lean(store, whole.unionByName(counts.select("node", "root", "links")), "placed")
    known = nodes.join(placed, "node", "left").select(
        "digest", "first_doc", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links")
    )
    least = known.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    return known.join(least, "root")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of): one row per row of `docs`; `copy_of` is the least id of its text.

    A null id is kept and is never the least unless its class has no other.
    """
    classes = jaccard_classes(docs, threshold, tolerance)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    )
    return rows.join(classes, "digest").select("doc_id", "class_id", "n_links", F.col("first_doc").alias("copy_of"))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with one left of each class: the one with the least (doc_id, text digest).

    All columns stay. Exact copies are of one class too; repeated rows leave one.
    """
    classes = jaccard_classes(docs, threshold)
    best = classes.groupBy("root").agg(
        F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "digest", "copies")).alias("b")
    )
    best = best.select(F.col("b.first_doc").alias("bi"), F.col("b.digest").alias("bd"), F.col("b.copies").alias("copies"))
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").cast("bigint").alias("i"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("d"),
    )
    kept = rows.join(best, (F.col("d") == F.col("bd")) & F.col("i").eqNullSafe(F.col("bi")))
    repeated = kept.where("copies > 1").dropDuplicates(["i", "d"])
    return kept.where("copies = 1").unionByName(repeated).select("doc.*")


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join(table(spark, sf, "documents").select("doc_id", "text"))
