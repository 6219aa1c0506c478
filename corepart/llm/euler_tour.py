"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Its enter and exit arcs are linked into one tour of
the tree: from a node to its first child, from child to child, and from the last one back. The
tour is ranked as a list: arcs that follow each other inside a block are joined to chains,
a random part of the chains is spliced out round by round until few are left, and the
sums come back in reverse order. What lies between a node's two arcs is its subtree, so leaves
and savings of all subtrees are differences of two prefix sums.

Texts are hashed where they are read; all shuffles are of short rows. Orders are global (range
partitions with one row each at the driver), so neither a conversation, nor the children of a
node, nor the members of a node must fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.registry import query, table
from corepart.llm.saving import save_lean
from corepart.operators.order import dense_index
from corepart.store import Store

SHARED = 9  # a conversation begins with fewer turns than this of its base
FAMILY = 5  # conversations of one base
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, for two rolling hashes modulo 2 ** 64
BLOCK = 1 << 16  # arcs in one block
FEW = 1 << 17  # chains that one task ranks
IDS = 4096  # ids in one piece of a node's list
PIECES = 512  # pieces a task gets at once


# --- running values along a global order ---------------------------------------------


def _partitioned(rows: DataFrame, *order) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** e modulo 2 ** 64."""
    out, square = np.ones(len(exponents), np.uint64), base % (1 << 64)
    left = exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        left, square = left >> np.uint64(1), square * square % (1 << 64)
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name))


def along_conversations(rows: DataFrame, order: list, store: Store, tag: str) -> DataFrame:
    """(conv_id, d, a, b, bytes, pa, pb, qa, qb): d counts a conversation's rows from 1 in `order`.

    pa and pb are rolling hashes of the turns up to this one, qa and qb up to the one before. `rows` has
    conv_id, the turn's hash words a and b, and bytes. A conversation may span partitions:
    each sends its last conversation's count and hashes to the driver, which hands them on.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, count, hashes = None, 0, [0, 0]
        for batch in batches:
            ids = _column(batch, "conv_id")
            if not len(ids):
                continue
            at = np.arange(len(ids))
            new = np.append(ids[0] != conv, ids[1:] != ids[:-1])
            begin = np.maximum.accumulate(np.where(new, at, 0))
            going_on = ~np.logical_or.accumulate(new)  # rows of the conversation that the last batch ended with
            d = at - begin + 1 + np.where(going_on, count, 0)
            out = []
            for k, word in enumerate(("a", "b")):
                up, down = _powers(BASES[k], at), _powers(pow(BASES[k], -1, 1 << 64), at)
                sums = np.append(np.uint64(0), np.cumsum(_column(batch, word).view(np.uint64) * down, dtype=np.uint64))
                own = (sums[1:] - sums[begin]) * up
                if going_on.any():
                    own = own + np.where(going_on, _powers(BASES[k], at + 1) * np.uint64(hashes[k]), np.uint64(0))
                out.append(own)
            conv, count, hashes = ids[-1], int(d[-1]), [int(h[-1]) for h in out]
            columns = [batch.column(c) for c in ("conv_id", "a", "b", "bytes", "_pid")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(d), *map(_signed, out)], ["conv_id", "a", "b", "bytes", "_pid", "d", "pa", "pb"])

    schema = "conv_id bigint, a bigint, b bigint, bytes bigint, _pid int, d bigint, pa bigint, pb bigint"
    sorted_rows = _partitioned(rows.select(*dict.fromkeys(["conv_id", "a", "b", "bytes", *order])), "conv_id", *order)
    stored = save_lean(store, sorted_rows.mapInArrow(local, schema), f"{tag}-local")
    ends = stored.groupBy("_pid").agg(
        F.min("conv_id").alias("first"), F.max_by(F.struct("conv_id", "d", "pa", "pb"), F.struct("conv_id", "d")).alias("last")
    )
    carried, conv, count, hashes = {}, None, 0, [0, 0]
    for r in sorted(ends.collect(), key=lambda r: r._pid):  # one row per partition
        before = (count, *hashes) if r.first == conv else (0, 0, 0)
        if before[0]:
            carried[r._pid] = (r.first, *before)
        more = before if r.last.conv_id == r.first else (0, 0, 0)
        conv, count = r.last.conv_id, r.last.d + more[0]
        hashes = [(own + pow(base, r.last.d, 1 << 64) * h) % (1 << 64) for own, base, h in zip((r.last.pa, r.last.pb), BASES, more[1:], strict=True)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pid, d = _column(batch, "conv_id"), _column(batch, "_pid"), _column(batch, "d").copy()
            through = [_column(batch, c).view(np.uint64).copy() for c in ("pa", "pb")]
            for p in np.unique(pid):
                if int(p) in carried:
                    first, *before = carried[int(p)]
                    rows = np.flatnonzero((pid == p) & (ids == first))
                    for k in (0, 1):
                        through[k][rows] += _powers(BASES[k], d[rows]) * np.uint64(before[1 + k])
                    d[rows] += before[0]
            ahead = [(h - _column(batch, c).view(np.uint64)) * np.uint64(pow(base, -1, 1 << 64)) for h, c, base in zip(through, "ab", BASES, strict=True)]
            columns = [batch.column("conv_id"), pa.array(d), batch.column("a"), batch.column("b"), batch.column("bytes")]
            yield pa.RecordBatch.from_arrays([*columns, *map(_signed, through), *map(_signed, ahead)], names)

    names = ["conv_id", "d", "a", "b", "bytes", "pa", "pb", "qa", "qb"]
    out = stored.select("conv_id", "a", "b", "bytes", "_pid", "d", "pa", "pb").mapInArrow(whole, ", ".join(f"{c} bigint" for c in names))
    out = save_lean(store, out, tag)
    store.drop(f"{tag}-local")
    return out


# --- conversations and nodes ---------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, bytes): each turn as 120 bits of SHA-256 of role and text, and the text's size."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
    )

    def word(at: int):
        return F.conv(F.substring("digest", at, 15), 16, 10).cast("bigint")

    return rows.select("conv_id", "turn", word(1).alias("a"), word(16).alias("b"), "bytes")


def shared_turns(conv_id):
    return F.crc32(conv_id.cast("string")) % SHARED


def rebuilt(conversations: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations as rows of `along_conversations`, and (conv_id) of all, also turnless ones."""
    turns = save_lean(store, turn_rows(conversations), "turns")
    convs = save_lean(store, turns.select("conv_id").distinct(), "convs")
    placed = along_conversations(turns, ["turn", "a", "b"], store, "placed")
    c = F.col("conv_id")
    family = convs.select("conv_id", (c - c % FAMILY).alias("base"), shared_turns(c).alias("h"))
    heads = placed.where((F.col("d") < SHARED) & (c % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(family, "base").where("d <= h").select("conv_id", F.lit(0).alias("own"), "d", "a", "b", "bytes")
    tails = placed.where(F.col("d") > shared_turns(c)).select("conv_id", F.lit(1).alias("own"), "d", "a", "b", "bytes")
    rows = save_lean(store, heads.unionByName(tails), "joined")
    return along_conversations(rows, ["own", "d"], store, "rebuilt"), convs


def trie_nodes(rows: DataFrame, convs: DataFrame, store: Store) -> DataFrame:
    """(idx, conv_id, d, n, bytes, pa, pb, qa, qb): one row per node, in order of (conv_id, d) from 0.

    A node's conv_id is its smallest member, so (conv_id, d) is unique, and a path without a
    branch has numbers in a row.
    """
    first = F.struct("bytes", "qa", "qb")
    below = rows.groupBy("d", "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.any_value(first).alias("x"))
    nothing = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    root = root.select(nothing.alias("d"), nothing.alias("pa"), nothing.alias("pb"), "conv_id", "n", nothing.alias("bytes"), nothing.alias("qa"), nothing.alias("qb"))
    below = below.select("d", "pa", "pb", "conv_id", "n", "x.bytes", "x.qa", "x.qb")
    return save_lean(store, dense_index(root.unionByName(below), ["conv_id", "d"], out="idx"), "nodes")


def family_links(nodes: DataFrame, store: Store) -> DataFrame:
    """(idx, parent, parent_conv, ahead) of every node but the root.

    `ahead` is the arc before the node's enter arc: its parent's enter arc or its next smaller
    sibling's exit arc. A parent's row is sorted right before its children, and values are handed on
    along that order, across partitions too.
    """
    key = ["d", "pa", "pb"]
    parents = nodes.select(*key, F.lit(0).alias("child"), "idx", "conv_id")
    children = nodes.where("d > 0").select((F.col("d") - 1).alias("d"), F.col("qa").alias("pa"), F.col("qb").alias("pb"), F.lit(1).alias("child"), "idx", "conv_id")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, conv, last, done = None, None, None, 0
        for batch in batches:
            child, idx, ids = _column(batch, "child"), _column(batch, "idx"), _column(batch, "conv_id")
            if not len(idx):
                continue
            at = np.maximum.accumulate(np.where(child == 0, np.arange(len(idx)), -1))
            arc = 2 * idx + child  # enter a parent, leave a sibling
            known = at >= 0
            up = np.where(known, idx[at], 0 if parent is None else parent)
            up_conv = np.where(known, ids[at], 0 if conv is None else conv)
            ahead = np.append(0 if last is None else last, arc[:-1])
            no_parent, no_last = ~known & (parent is None), (np.arange(len(idx)) == 0) & (last is None)
            parent, conv, last = (None if no_parent[-1] else up[-1]), (None if no_parent[-1] else up_conv[-1]), arc[-1]
            columns = [batch.column("_pid"), batch.column("child"), batch.column("idx")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(arc), pa.array(up, mask=no_parent), pa.array(up_conv, mask=no_parent), pa.array(ahead, mask=no_last), pa.array(np.arange(len(idx)) + done)],
                ["_pid", "child", "idx", "arc", "parent", "parent_conv", "ahead", "at"],
            )
            done += len(idx)

    schema = "_pid int, child int, idx bigint, arc bigint, parent bigint, parent_conv bigint, ahead bigint, at bigint"
    records = _partitioned(parents.unionByName(children), *key, "child", "idx")
    stored = save_lean(store, records.mapInArrow(local, schema), "links-local")
    last = stored.groupBy("_pid").agg(F.max_by(F.struct("arc", "parent", "parent_conv"), "at").alias("x"))
    handed, arc, parent, conv = [], None, None, None
    for r in sorted(last.collect(), key=lambda r: r._pid):  # one row per partition
        handed.append((r._pid, arc, parent, conv))
        arc = r.x.arc
        if r.x.parent is not None:
            parent, conv = r.x.parent, r.x.parent_conv
    before = nodes.sparkSession.createDataFrame(handed, "_pid int, l_arc bigint, l_parent bigint, l_conv bigint")
    out = stored.where("child = 1").join(F.broadcast(before), "_pid").select(
        "idx", F.coalesce("parent", "l_parent").alias("parent"), F.coalesce("parent_conv", "l_conv").alias("parent_conv"), F.coalesce("ahead", "l_arc").alias("ahead")
    )
    return save_lean(store, out, "links")


# --- list ranking --------------------------------------------------------------------


def _totals(ahead: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First element of each element's chain, and the sums from it to the element itself.

    `ahead` is the place of the element before, or -1; pointers double until all reach the first.
    """
    head, sums, ahead = np.arange(len(ahead)), weights.copy(), ahead.copy()
    while (moving := np.flatnonzero(ahead >= 0)).size:
        to = ahead[moving]
        add, reach, on = sums[to], head[to], ahead[to]
        sums[moving] += add
        head[moving], ahead[moving] = reach, on
    return head, sums


def chains(arcs: DataFrame, block: int) -> DataFrame:
    """(arc, head, leaf, saving, tail, outside): arcs (arc, ahead, leaf, saving) within their block.

    leaf and saving become sums from the chain's head on; `outside` is the arc before a head, and a
    tail is before no arc of its block. Numbers are dense, so a block has at most `block` arcs.
    """

    def join(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("arc").combine_chunks()
        arc, ahead = (np.asarray(batch.column(c)) for c in ("arc", "ahead"))
        place = np.searchsorted(arc, ahead)
        inside = arc[np.minimum(place, len(arc) - 1)] == ahead
        own = np.where(inside, place, -1)
        head, sums = _totals(own, np.stack([np.asarray(batch.column(c)) for c in ("leaf", "saving")], 1))
        tail = np.ones(len(arc), bool)
        tail[own[inside]] = False
        columns = [pa.array(arc), pa.array(arc[head]), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.array(tail)]
        return pa.Table.from_arrays([*columns, pa.array(ahead, mask=inside)], ["arc", "head", "leaf", "saving", "tail", "outside"])

    dealt = arcs.withColumn("block", F.floor(F.col("arc") / block)).groupBy("block")
    return dealt.applyInArrow(join, "arc bigint, head bigint, leaf bigint, saving bigint, tail boolean, outside bigint")


def rank_list(items: DataFrame, store: Store, few: int) -> DataFrame:
    """(id, leaf, saving): sums over all items before each, for items (id, ahead, leaf, saving).

    An item's leaf and saving are what its predecessor `ahead` (null for the first) adds. While more
    than `few` are left, an item whose coin shows 1 and whose predecessor's shows 0 is
    spliced out: about a quarter in each round, never two neighbours. One task ranks the rest.
    """
    left, gone = items, 0
    while left.count() > few:
        coin = lambda c, salt=gone: F.xxhash64(F.col(c), F.lit(salt)) % 2 == 0
        out = F.col("ahead").isNotNull() & coin("id") & ~coin("ahead")
        taken = save_lean(store, left.where(out), f"taken-{gone}")
        middle = taken.select(F.col("id").alias("m"), F.col("ahead").alias("m_ahead"), F.col("leaf").alias("m_leaf"), F.col("saving").alias("m_saving"))
        kept = left.where(~out).join(middle, F.col("ahead") == F.col("m"), "left")
        kept = kept.select(
            "id",
            F.coalesce("m_ahead", "ahead").alias("ahead"),
            (F.col("leaf") + F.coalesce("m_leaf", F.lit(0))).alias("leaf"),
            (F.col("saving") + F.coalesce("m_saving", F.lit(0))).alias("saving"),
        )
        left = save_lean(store, kept, f"kept-{gone}")
        store.drop(f"kept-{gone - 1}")
        gone += 1

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema=schema).sort_by("id").combine_chunks()
        ids = np.asarray(rows.column("id"))
        if not len(ids):
            return
        ahead = rows.column("ahead").fill_null(-1).to_numpy()
        own = np.where(ahead >= 0, np.searchsorted(ids, ahead), -1)
        _, sums = _totals(own, np.stack([rows.column(c).to_numpy() for c in ("leaf", "saving")], 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], ["id", "leaf", "saving"])

    schema = pa.schema([(c, pa.int64()) for c in ("id", "ahead", "leaf", "saving")])
    ranked = save_lean(store, left.select("id", "ahead", "leaf", "saving").repartition(1).mapInArrow(rest, "id bigint, leaf bigint, saving bigint"), f"ranked-{gone}")
    for r in reversed(range(gone)):
        known = ranked.select(F.col("id").alias("ahead"), F.col("leaf").alias("k_leaf"), F.col("saving").alias("k_saving"))
        back = store.read(f"taken-{r}").join(known, "ahead").select("id", (F.col("leaf") + F.col("k_leaf")).alias("leaf"), (F.col("saving") + F.col("k_saving")).alias("saving"))
        ranked = save_lean(store, ranked.unionByName(back), f"ranked-{r}")
        store.drop(f"ranked-{r + 1}")
    return ranked


def tour_sums(arcs: DataFrame, store: Store, block: int, few: int) -> DataFrame:
    """(arc, leaf, saving): sums along the whole tour up to each arc, itself included."""
    joined = save_lean(store, chains(arcs, block), "chains")
    tails = joined.where("tail").select(F.col("arc").alias("outside"), F.col("head").alias("ahead"), "leaf", "saving")
    heads = joined.where("arc = head").select(F.col("arc").alias("id"), "outside")
    zero = F.lit(0).cast("bigint")
    items = heads.join(tails, "outside", "left").select("id", "ahead", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saving", zero).alias("saving"))
    before = rank_list(save_lean(store, items, "items"), store, few)
    before = before.select(F.col("id").alias("head"), F.col("leaf").alias("b_leaf"), F.col("saving").alias("b_saving"))
    return joined.join(before, "head").select("arc", (F.col("leaf") + F.col("b_leaf")).alias("leaf"), (F.col("saving") + F.col("b_saving")).alias("saving"))


# --- members' lists and the whole operator -------------------------------------------


def ends_digests(ends: DataFrame, store: Store) -> DataFrame:
    """(d, pa, pb, digest): SHA-256 of each node's ids, ascending, joined by commas, of rows (d, pa, pb, conv_id).

    Ids become pieces of text where they are sorted; a node's pieces are then hashed one after the
    other. A hash of one long text can't be split, but its task reads one row for IDS ids and
    holds PIECES of them.
    """
    names = ["d", "pa", "pb", "first", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([_column(batch, c) for c in ("d", "pa", "pb")], 1)
            ids = _column(batch, "conv_id")
            if not len(ids):
                continue
            new = np.append(True, (keys[1:] != keys[:-1]).any(1))
            starts = [s for lo, hi in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(ids)], strict=True) for s in range(lo, hi, IDS)]
            text = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[starts, k]) for k in range(3)), pa.array(ids[starts]), pa.array(text, pa.string())], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "pa", "pb", "ids")), strict=True):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            yield rows_of(out)
        yield rows_of([(*now, state.hexdigest())] if now else [])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "pa", "pb", "digest"])

    key = ["d", "pa", "pb"]
    order = [*key, "conv_id"]
    cut = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "d bigint, pa bigint, pb bigint, first bigint, ids string")
    cut = save_lean(store, cut, "pieces").repartition(*key).sortWithinPartitions(*key, "first")
    return save_lean(store, cut.mapInArrow(digests, "d bigint, pa bigint, pb bigint, digest string"), "digests", PIECES)


def prefix_trie(conversations: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by `turn`, null first, and equal ones by a hash of role and text; a repeated
    row is a turn of its own. A null role or text is empty. Rows without a conv_id take no part. A
    conversation whose base is not there keeps its own turns after the first h only, and may
    be turnless. No row at all gives no node, not even a root.
    """
    store = Store(conversations.sparkSession, "euler-tour")
    rows, convs = rebuilt(conversations, store)
    nodes = trie_nodes(rows, convs, store)
    links = family_links(nodes, store)
    families = links.groupBy("parent").agg(F.max("idx").alias("last"), F.count(F.lit(1)).alias("n_children"))
    whole = nodes.join(links, "idx", "left").join(families.withColumnRenamed("parent", "idx"), "idx", "left")
    whole = save_lean(store, whole.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "whole")

    i, zero = F.col("idx"), F.lit(0).cast("bigint")
    enter = F.struct(
        (2 * i).alias("arc"),
        F.coalesce("ahead", F.lit(-1)).alias("ahead"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n") - 1) * F.col("bytes")).alias("saving"),
    )
    leave = F.struct((2 * i + 1).alias("arc"), F.coalesce(2 * F.col("last") + 1, 2 * i).alias("ahead"), zero.alias("leaf"), zero.alias("saving"))
    arcs = whole.select(F.inline(F.array(enter, leave)))
    sums = tour_sums(arcs, store, block, few)
    # The sum at a node's exit arc less that at its enter arc, which holds the node itself, plus the node.
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    inner = sums.groupBy(F.floor(F.col("arc") / 2).alias("idx")).agg(F.sum(sign * F.col("leaf")).alias("leaf"), F.sum(sign * F.col("saving")).alias("saving"))

    last = rows.groupBy("conv_id").agg(F.max(F.struct("d", "pa", "pb")).alias("end"))
    ends = convs.join(last, "conv_id", "left").select(*(F.coalesce(F.col("end")[c], zero).alias(c) for c in ("d", "pa", "pb")), "conv_id")
    found = ends_digests(ends, store)
    none = hashlib.sha256(b"").hexdigest()
    out = whole.join(inner, "idx").join(found, ["d", "pa", "pb"], "left").select(
        "conv_id",
        F.col("d").alias("depth"),
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        (F.col("leaf") + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
        (F.col("saving") + (F.col("n") - 1) * F.col("bytes")).alias("saved_tokens"),
        F.coalesce("digest", F.lit(none)).alias("ends_sha256"),
    )
    out = save_lean(store, out, "trie")
    store.keep_only("trie")
    return out


# The CRC-32 of a text of digits, bit by bit; DuckDB has no such function.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS t, octet_length(encode(text)) AS bytes, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS pos FROM turns),
own AS (SELECT conv_id, array_agg({{'t': t, 'bytes': bytes}} ORDER BY pos) AS l FROM placed GROUP BY conv_id),
h AS (SELECT conv_id, l, ({_CRC} % 9)::BIGINT AS h FROM own),
built AS (
  SELECT h.conv_id, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) AS l
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
steps AS (SELECT conv_id, unnest(range(0, len(l) + 1)) AS d, l FROM built),
rows AS (SELECT conv_id, d, d = len(l) AS ends, array_to_string([x.t for x in l[1:d]], ',') AS k,
  array_to_string([x.t for x in l[1:d - 1]], ',') AS up, coalesce(l[d].bytes, 0) AS bytes FROM steps),
nodes AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM rows GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
subtree AS (
  SELECT r.d, r.k, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n - 1) * x.bytes)::BIGINT AS saved_tokens
  FROM full_nodes x JOIN rows r ON r.conv_id = x.conv_id AND r.d <= x.d GROUP BY r.d, r.k)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM full_nodes x JOIN subtree s ON s.d = x.d AND s.k = x.k LEFT JOIN full_nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.k = x.up
"""


@query("op13_euler_tour", SQL)
def op13_euler_tour(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(table(spark, sf, "conversations"))
