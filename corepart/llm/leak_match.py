"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by k = floor(m * error_rate) edits. It is split into
k + 1 pieces: any text within k edits holds at least one piece unchanged. The pieces of a
block of items make one automaton, which finds all piece hits in a text in one pass; each hit
names a place, where Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.kept import kept
from corepart.llm.packed import packed, pieces
from corepart.llm.registry import query, table

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000  # characters of test items in one automaton and broadcast
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case; each run of what is neither letter nor digit is one blank."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def best_distance(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any part of the text (Myers, 1999)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pos, neg, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        across = eq | neg
        eq |= ((eq & pos) + pos) ^ pos
        up = neg | (full & ~(eq | pos))
        down = pos & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = up << 1 & full  # a match may begin anywhere
        down = down << 1 & full
        pos = down | (full & ~(across | up))
        neg = up & across
    return best


class LeakMatcher:
    """The pieces of a block of test items, and the search for them."""

    def __init__(self, items: list[str], error_rate: float):
        self.items = [normal(t) for t in items]
        self.edits = [int(len(t) * error_rate) for t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (text, k) in enumerate(zip(self.items, self.edits, strict=True)):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    pieces.setdefault(text[lo:hi], []).append((n, lo))
        self.pieces = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.pieces.add_word(piece, (len(piece), uses))
        if pieces:
            self.pieces.make_automaton()
        self.empty = not pieces

    def find(self, text: str | None) -> dict[int, int]:
        """Number of each item found in the text, with its least distance there."""
        if self.empty:
            return {}
        body = normal(text)
        places: dict[int, set[int]] = {}
        for last, (size, uses) in self.pieces.iter(body):
            for n, offset in uses:
                places.setdefault(n, set()).add(last + 1 - size - offset)
        found = {}
        for n, starts in places.items():
            distance = self._verify(n, sorted(starts), body)
            if distance is not None:
                found[n] = distance
        return found

    def _verify(self, n: int, starts: list[int], body: str) -> int | None:
        item, k = self.items[n], self.edits[n]
        m = len(item)
        if any(s >= 0 and body.startswith(item, s) and _whole(body, s, s + m) for s in starts):
            return 0
        if not k:
            return None
        best, lo = k + 1, 0
        for hi in range(len(starts)):
            if hi + 1 == len(starts) or starts[hi + 1] - starts[hi] > 2 * k:  # a run of near places
                region = body[max(0, starts[lo] - k) : starts[hi] + m + k]
                best = min(best, best_distance(item, region))
                lo = hi + 1
        return best if best <= k else None


def _whole(body: str, lo: int, hi: int) -> bool:
    """No letter or digit goes on before or after."""
    return not (lo and body[lo - 1] != " ") and not (hi < len(body) and body[hi] != " ")


def _matcher(block: tuple, error_rate: float) -> LeakMatcher:
    """The matcher of a block of items; a worker keeps it for the tasks on the same block."""
    _, texts, name = block
    return kept(("matcher", name, error_rate), lambda: LeakMatcher(list(texts), error_rate))


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Broadcast]:
    """The distinct items as broadcasts of bounded size, of (ids, texts, a name), one after the other.

    The driver holds one block at a time. Items without letter and digit are left out.
    """
    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).distinct()
    context = items.sparkSession.sparkContext
    ids, texts, size = [], [], 0
    for row in rows.where(F.col("text").isNotNull()).toLocalIterator():
        if not normal(row.text):
            continue
        if ids and size + len(row.text) > BLOCK_CHARS:
            yield context.broadcast((tuple(ids), tuple(texts), uuid.uuid4().hex))
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
    if ids:
        yield context.broadcast((tuple(ids), tuple(texts), uuid.uuid4().hex))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    error_rate: float = ERROR_RATE,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, distance, edits): every document and item it holds within the edits.

    Texts are compared in lower case with blanks for all other characters. Items too short for
    an edit must be there whole, between blanks. Null and empty documents and items match
    nothing. Repeated documents give repeated rows, repeated items (same id and text) one.
    """
    out = None
    schema = "doc_id bigint, item_id bigint, distance int, edits int"
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), "text")
    for block in item_blocks(items, item_id, "text"):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, matcher = block.value[0], _matcher(block.value, error_rate)
            for batch in batches:
                found = [
                    (doc, ids[n], distance, matcher.edits[n])
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for n, distance in matcher.find(text.as_py()).items()
                ]
                columns = zip(*found, strict=True) if found else [[], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "edits"]
                )

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item."""
    out, at = packed(docs, "doc")
    kind = out.schema
    for block in item_blocks(items, "item_id", "text"):

        def sift(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block.value, error_rate)
            for piece, texts in pieces(batches, at):
                yield piece.filter(pa.array([not matcher.find(t.as_py()) for t in texts], pa.bool_()))

        out = out.mapInArrow(sift, kind)
    return out.select("doc.*")


@query("op1_leak_match")
def op1_leak_match(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
