"""Repeated byte strings by a depth-limited most-significant-digit radix sort of suffixes.

Only the first LENGTH bytes of a suffix count, so equal groups after the last digit are exactly
the strings of LENGTH bytes that repeat. The passes:

- Digit 0 deals suffixes to groups. It is the hash of the SEED-byte substring with the least
  hash among those inside the suffix's first LENGTH bytes, so equal suffixes have equal digits.
  Suffixes in a row mostly share it; such a run is sorted as one (a start and a count).
- A group within one document is done. Runs that are equal as a whole are decided together, by
  a hash of all their bytes.
- The other runs of a group are spread to suffixes and sorted by digits of eight bytes, most
  significant first. After each digit, groups within one document drop out.

A string is removed where it also starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.jaccard_join import _joined
from corepart.llm.registry import query, table
from corepart.llm.saving import save_lean
from corepart.llm.shingles import BYTE, _powers, mix
from corepart.store import Store

LENGTH = 50
SEED = 24
PIECE = 1 << 19  # bytes hashed at once; under 2 ** 20
RUNS = 500_000  # runs in one bucket of digit 0, about 12 MB, and eight times that while it is sorted
BLOCKS = 16  # rows of blocks, and ROWS of texts, that a task gets at once
ROWS = 1000
SORTED = 20_000  # runs spread to suffixes at once
LAST = np.int64(2**63 - 1)  # stands for a null id, which is after all others
LOW = np.uint64((1 << 20) - 1)
# Hashes of 48 bits, document number in its block, start, count.
RUN = np.dtype([("key", "u1", 6), ("run", "u1", 6), ("doc", "<u4"), ("at", "<u4"), ("n", "u1")])


def suffix_runs(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, run, at, n) arrays for the suffixes of a text, piece by piece.

    Suffixes at .. at + n - 1 share digit 0 `key`; `run` hashes all bytes they reach and where
    in them the key's substring is.
    """
    power, inverse = _powers(PIECE + LENGTH + 1)
    wide = length - seed + 1
    for lo in range(0, len(data) - length + 1, PIECE):
        part = data[lo : lo + PIECE + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * power[: len(part)], out=sums[1:])
        hashes = mix((sums[seed:] - sums[:-seed]) * inverse[: len(part) - seed + 1])
        # The least hash in each window by doubling; the place is in the low bits, so ties go left.
        least = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(hashes) - wide + 1], least[wide - span :])
        place = (least & LOW).astype(np.int64)
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        n = np.diff(np.append(begin, len(place)))
        to = begin + n + length - 1
        whole = (sums[to] - sums[begin]) * inverse[begin]
        offset = (place[begin] - begin).astype(np.uint64)
        run = mix(mix(whole + n.astype(np.uint64)) + offset)
        # Least hashes are small: mixed again they spread evenly over the buckets.
        yield mix(hashes[place[begin]]), run, begin + lo, n


def _six(values: np.ndarray) -> np.ndarray:
    """The first six bytes of 64-bit values."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6]


def _wide(six: np.ndarray) -> np.ndarray:
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.int64)[:, 0]


def _dealer(buckets: int, length: int, seed: int):
    """(id, h, text) batches to (bucket, ids, runs): blocks of runs by digit 0."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        docs: list[tuple[int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, run, at, n, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = ((key >> np.uint64(32)).astype(np.int64) * buckets) >> 32
            order = np.argsort(bucket, kind="stable")
            rows = np.zeros(len(key), RUN)
            rows["key"], rows["run"], rows["doc"], rows["at"], rows["n"] = _six(key), _six(run), doc, at, n
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            names = np.array(docs, np.int64).reshape(-1, 2)
            ids, runs = [], []
            for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                used, rows["doc"][lo:hi] = np.unique(rows["doc"][lo:hi], return_inverse=True)
                ids.append(names[used].tobytes())
                runs.append(rows[lo:hi].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts], pa.int32()), pa.array(ids, pa.binary()), pa.array(runs, pa.binary())], ["bucket", "ids", "runs"]
            )

        for batch in batches:
            for i, h, text in zip(*(batch.column(j) for j in range(3)), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                docs.append((i.as_py(), h.as_py()))
                for key, run, at, n in suffix_runs(data, length, seed):
                    held.append((key, run, at, n, np.full(len(key), len(docs) - 1, np.uint32)))
                    size += len(data[:PIECE])
                    if size >= 8 << 20:
                        yield flush()
                        held, size, docs = [], 0, [docs[-1]]
        if held:
            yield flush()

    return deal


VERDICTS = "id bigint, h bigint, key bigint, at bigint, n int, whole boolean"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by bucket, to the runs that repeat as a whole, and those to be compared."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last = None

    def judge() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([r for r, _, _ in held])
        ids, h = np.concatenate([i for _, i, _ in held]), np.concatenate([h for _, _, h in held])
        key, run = _wide(rows["key"]), _wide(rows["run"])
        order = np.lexsort((ids, run, key))
        key, run, ids, h, rows = key[order], run[order], ids[order], h[order], rows[order]
        new_key = np.append(True, key[1:] != key[:-1])
        new_run = new_key | np.append(True, run[1:] != run[:-1])
        first = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - 1
        least = np.minimum.reduceat(ids, first)[group]
        several = np.maximum.reduceat(ids, first)[group] != least
        mixed = np.add.reduceat(new_run.astype(np.int64), first)[group] > 1
        least_run = ids[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
        whole = ids > least_run
        # One run of each kind stands for all; a later document's copies of it are whole repeats.
        compare = several & mixed & (ids == least_run)
        use = whole | compare
        del new_key, new_run, group, least, several, mixed, least_run, run
        picked = np.flatnonzero(use)
        for lo in range(0, len(picked), 100_000):
            pick = picked[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[pick]),
                    pa.array(h[pick]),
                    pa.array(key[pick]),
                    pa.array(rows["at"][pick].astype(np.int64)),
                    pa.array(rows["n"][pick].astype(np.int32)),
                    pa.array(whole[pick]),
                ],
                ["id", "h", "key", "at", "n", "whole"],
            )

    for batch in batches:
        for bucket, names, runs in zip(*batch.columns, strict=True):
            if held and bucket.as_py() != last:
                yield from judge()
                held = []
            last = bucket.as_py()
            rows = np.frombuffer(runs.as_py(), RUN)
            doc = np.frombuffer(names.as_py(), np.int64).reshape(-1, 2)[rows["doc"]]
            held.append((rows, doc[:, 0], doc[:, 1]))
    if held:
        yield from judge()


def sort_suffixes(group: np.ndarray, ids: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """True for each row of `suffixes` that also is one of its group with a smaller id.

    Radix passes over eight bytes at a time; groups within one document drop out after each.
    """
    length = suffixes.shape[1]
    digits = np.zeros((len(suffixes), -(-length // 8) * 8), np.uint8)
    digits[:, :length] = suffixes
    digits = digits.view(">u8")
    out = np.zeros(len(suffixes), bool)
    left = np.arange(len(suffixes))
    group = np.unique(group, return_inverse=True)[1]
    for depth in range(digits.shape[1] + 1):
        if depth:
            digit = digits[left, depth - 1].astype(np.uint64)
            order = np.lexsort((digit, group))
            left, digit, group = left[order], digit[order], group[order]
            new = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        else:
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            new = group[1:] != group[:-1]
        if not len(left):
            return out
        first = np.flatnonzero(np.append(True, new))
        group = np.cumsum(np.append(True, new)) - 1
        own = ids[left]
        least = np.minimum.reduceat(own, first)[group]
        several = np.maximum.reduceat(own, first)[group] != least
        left, group, least, own = left[several], group[several], least[several], own[several]
    out[left[own > least]] = True
    return out


def _compared(length: int, seed_size: int = SEED):
    """Runs with their bytes, sorted by key, to the spans (id, h, lo, hi) that repeat."""

    def spans(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, ids, h, at, n = (np.asarray(rows.column(j)).astype(np.int64) for j in range(5))
        data = rows.column(5)
        text = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        begin = np.append(0, np.cumsum(n + length - 1))[:-1]
        found: list[np.ndarray] = []
        # A hot group is spread one place at a time: suffixes with the seed elsewhere differ.
        steps = [None] if len(n) <= SORTED else range(length - seed_size + 1)
        seed = np.asarray(rows.column(6)).astype(np.int64)
        for step in steps:
            if step is None:
                run = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(run)) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
            else:
                j = seed - step
                run = np.flatnonzero((j >= 0) & (j < n))
                j = j[run]
            if not len(run):
                continue
            suffixes = np.lib.stride_tricks.sliding_window_view(text, length)[begin[run] + j]
            hit = sort_suffixes(key[run], ids[run], suffixes)
            found.append(np.stack([run[hit], at[run[hit]] + j[hit]], 1))
        hits = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        run, start = hits[:, 0], hits[:, 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[run]), pa.array(h[run]), pa.array(start), pa.array(start + length)], ["id", "h", "lo", "hi"]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0))
            if held and len(key) and key[0] != held[-1].column(0)[-1].as_py() and sum(b.num_rows for b in held) >= SORTED // 4:
                yield from spans(_joined(held))
                held = []
            cut = int(np.flatnonzero(key == key[-1])[0])  # the last group may go on
            if cut and sum(b.num_rows for b in held) + cut >= SORTED // 4:
                yield from spans(_joined([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from spans(_joined(held))

    return compare


def _cutter(length: int, seed: int):
    """(runs, text) of a document to one row per run with its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, inverse = _powers(PIECE + LENGTH + 1)
        for batch in batches:
            out: list[tuple] = []
            for i, h, runs, text in zip(*batch.columns, strict=True):
                data = text.as_py()
                for run in runs.as_py():
                    part = data[run["at"] : run["at"] + run["n"] + length - 1]
                    array = np.frombuffer(part, np.uint8)
                    sums = np.append(np.zeros(1, np.uint64), np.cumsum(BYTE[array] * power[: len(array)], dtype=np.uint64))
                    hashes = mix((sums[seed:] - sums[:-seed]) * inverse[: len(array) - seed + 1])
                    place = int((hashes & ~LOW).argmin())
                    out.append((run["key"], i.as_py(), h.as_py(), run["at"], run["n"], part, place))
                if len(out) >= 4096:
                    yield _runs(out)
                    out = []
            if out:
                yield _runs(out)

    return cut


CUT = "key bigint, id bigint, h bigint, at bigint, n int, data binary, place int"


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    names = [c.split()[0] for c in CUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def merge(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and not touching spans that cover the same bytes."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], 1)


def repeated_spans(docs: DataFrame, store: Store, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, h, lo, hi): byte spans of rows (id, h, data) covered by strings that start in a smaller id.

    Spans may overlap. `h` tells rows of one id apart; they take nothing from each other.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    buckets = size * 2 // (length - seed + 2) // RUNS + 1
    # One bucket for each task at least: digit 0 is evenly spread, so a part of its range is.
    buckets = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = docs.mapInArrow(_dealer(buckets, length, seed), "bucket int, ids binary, runs binary")
    judged = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judged, VERDICTS)
    verdicts = save_lean(store, judged, "verdicts", BLOCKS)
    mixed = (
        verdicts.where("NOT whole")
        .groupBy("id", "h")
        .agg(F.collect_list(F.struct("key", "at", "n")).alias("runs"))
        .withColumnsRenamed({"id": "i", "h": "g"})
    )
    own = (F.col("i") == F.col("id")) & (F.col("g") == F.col("h"))
    cut = mixed.join(docs.dropDuplicates(["id", "h"]) if _repeated(docs) else docs, own).select("id", "h", "runs", "data")
    runs = cut.mapInArrow(_cutter(length, seed), CUT).repartition("key").sortWithinPartitions("key", "id")
    compared = save_lean(store, runs.mapInArrow(_compared(length, seed), "id bigint, h bigint, lo bigint, hi bigint"), "compared", ROWS)
    whole = verdicts.where("whole").select("id", "h", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (length - 1)).alias("hi"))
    return whole.unionByName(compared)


def _repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("id", "h").count().where("count > 1").isEmpty()


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, store: Store | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per row of `docs`.

    Texts are UTF-8 bytes, a null text is empty. A byte goes when a string of `length` bytes
    that covers it also starts in a document with a smaller doc_id; strings are those of the
    input. A null doc_id is greater than all others; rows of one doc_id take nothing from each
    other. `kept` is what is left, as bytes: a character may be cut.
    """
    store = store or Store(docs.sparkSession, "radix-repeats")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(LAST)))
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    clash = docs.select(key.alias("id"), F.xxhash64("text").alias("x")).groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # Texts under one id are told apart by a hash, which is left out where there are none.
    h = F.xxhash64("text") if not clash.where("a <> b").isEmpty() else F.lit(0).cast("bigint")
    rows = docs.select(key.alias("id"), h.alias("h"), data.alias("data"))
    spans = repeated_spans(rows, store, length, seed)
    by_doc = spans.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("id"), h.alias("h"), data.alias("data"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*batch.columns, strict=True):
                whole = text.as_py()
                values = spans.values if spans.is_valid else None
                found = np.zeros((0, 2), np.int64)
                if values is not None:
                    found = merge(np.stack([np.asarray(values.field(0)), np.asarray(values.field(1))], 1))
                edges = [0, *found.ravel().tolist(), len(whole)]
                kept = b"".join(whole[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc.as_py(), len(whole), len(whole) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names) if out else None

    stripped = named.join(by_doc, ["id", "h"], "left").select("doc_id", "data", "spans")
    return stripped.mapInArrow(
        lambda batches: (b for b in strip(batches) if b is not None),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
    )


@query("op8_radix_repeats")
def op8_radix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents").select("doc_id", "text")).drop("kept")
