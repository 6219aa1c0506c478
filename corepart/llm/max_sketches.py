"""Ranked lexical search by hashed max-sketches.

The index holds, for each document, its number of terms and one short sketch: terms fall into
hash buckets, and a bucket keeps the greatest number of occurrences of its terms, which gives the
coordinatewise maximum of their impacts. A batch of queries looks its buckets up in all
sketches; the sum is an upper bound of a document's score. Documents are then scored exactly
from their texts in descending order of the bound, block by block, until the next bound is
below the k-th best score found.

The index knows nothing of the queries. The texts are read once for it (and for the document
frequencies of the queries' terms), and once for each block of documents to be scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corepart.llm.registry import query, table
from corepart.llm.saving import save_lean
from corepart.llm.shingles import SLICE, word_hashes
from corepart.store import Store

BUCKETS = 1 << 14  # coordinates of a sketch; only those with a term are stored, 3 bytes each
MOST = 255  # a count from which a bucket stands for any number of occurrences
FULL = 1_000_000  # no impact is greater
QUERIES, QUERY_CHARS = 256, 1_000_000  # queries of one block, and their characters
BEST = 10
FIRST, GROWTH = 32, 32  # documents per query in the first block, and times as many in each next
SENT = 1 << 18  # candidates of a block that may be broadcast, about 40 bytes each
CELLS = 1 << 22  # numbers in one matrix of bounds or of sketches
ARROW_ROWS = 2000

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Capital letters A-Z become small; the underscore, which word_hashes takes for a letter, a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[95] = 32

INDEXED = "doc_id bigint, n bigint, buckets binary, tops binary, term int, docs bigint"


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters, digits and non-ASCII characters, A-Z lowered."""
    return _TERM.findall((text or "").encode().lower())


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, term hashes in order, offsets) for runs of texts of about SLICE bytes."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        yield lo, hi, *word_hashes(_FOLD[body[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo])
        lo = hi


def term_hashes(words: list[bytes]) -> np.ndarray:
    """The same hash of single terms."""
    found = [h for _, _, h, _ in _hashed(pa.array([w.decode() for w in words], pa.string()))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, occurrences) of every term of every text, by text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def _binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose item i holds the values from offsets[i] to offsets[i + 1]."""
    ends = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def index_documents(docs: DataFrame, vocabulary: np.ndarray, sketches: bool = True) -> DataFrame:
    """Rows of INDEXED: a sketch per document, and the documents that hold each term of a vocabulary.

    Sketch rows have doc_id, n (terms with repeats), the buckets in ascending order (two bytes
    each) and the greatest number of occurrences in each (one byte). The others have the term's
    place in the sorted `vocabulary` of hashes and a task's number of documents. Terms are told apart by 64 bits
    of hash. Every row of `docs` is a document, also a repeated one and one without an id; a null
    text has no terms.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary), np.int64)
        names = ["doc_id", "n", "buckets", "tops", "term", "docs"]
        for batch in batches:
            for lo, hi, hashes, first in _hashed(batch.column("text")):
                doc, term, tf = _counted(hashes, first)
                if len(vocabulary):
                    place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                    seen += np.bincount(place[vocabulary[place] == term], minlength=len(vocabulary))
                if not sketches:
                    continue
                cell = doc * BUCKETS + (term & np.uint64(BUCKETS - 1)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                cell, tf = cell[order], tf[order]
                at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
                tops = np.minimum(np.maximum.reduceat(tf, at), MOST).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
                offsets = np.searchsorted(cell[at], np.arange(hi - lo + 1) * BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        _binaries((cell[at] % BUCKETS).astype("<u2"), offsets),
                        _binaries(tops, offsets),
                        pa.nulls(hi - lo, pa.int32()),
                        pa.nulls(hi - lo, pa.int64()),
                    ],
                    names,
                )
        held = np.flatnonzero(seen)
        blank, none = pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.binary())
        yield pa.RecordBatch.from_arrays([blank, blank, none, none, pa.array(held, pa.int32()), pa.array(seen[held])], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(read, INDEXED)


@dataclass
class Corpus:
    """What scores need of all documents: those with a term, and all their terms."""

    n_docs: int
    n_terms: int

    def length(self, n: int) -> int:
        return 25 + 75 * n * self.n_docs // self.n_terms

    def weight(self, docs: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * docs + 1)))


def impact(tf: int, length: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * length)


class QueryBlock:
    """Queries that are looked up together: ids, and how often each has each of its terms."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        self.counts = [Counter(terms(t)) for _, t in rows]
        words = sorted(set().union(*self.counts)) if rows else []
        hashes = term_hashes(words)
        order = np.argsort(hashes)
        self.words, self.hashes = [words[i] for i in order], hashes[order]

    def lookups(self, weights: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """(column of each bucket or -1, weights by column and query): what a sketch is multiplied with."""
        bucket = (self.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        used, column = np.unique(bucket, return_inverse=True)
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        matrix = np.zeros((len(used), len(self.ids)))
        at = {w: c for w, c in zip(self.words, column, strict=True)}
        for q, counts in enumerate(self.counts):
            for word, times in counts.items():
                matrix[at[word], q] += times * weights[word]
        return place, matrix


def query_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[QueryBlock]:
    """The distinct (id, text) rows that have a term, in blocks of bounded size, one after the other."""
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    held, size = [], 0
    for row in rows.toLocalIterator():
        if not terms(row.t):
            continue
        if held and (len(held) == QUERIES or size + len(row.t) > QUERY_CHARS):
            yield QueryBlock(held)
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    if held:
        yield QueryBlock(held)


def upper_bounds(batch: pa.RecordBatch, corpus: Corpus, place: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, bounds by row and query) for runs of sketches. Sums of whole numbers below 2 ** 53: exact."""
    step = max(1, CELLS // max(matrix.shape))
    n = np.asarray(batch.column("n"))
    for lo in range(0, len(batch), step):
        part = batch.slice(lo, step)
        buckets, tops = part.column("buckets").to_pylist(), part.column("tops").to_pylist()
        size = np.array([len(t) for t in tops])
        doc = np.repeat(np.arange(len(size)), size)
        column = place[np.frombuffer(b"".join(buckets), "<u2")]
        tf = np.frombuffer(b"".join(tops), np.uint8).astype(np.int64)
        use = column >= 0
        doc, column, tf = doc[use], column[use], tf[use]
        # a length that rounding makes too small only raises the bound
        length = np.floor(25 + 75.0 * n[lo : lo + step] * (corpus.n_docs / corpus.n_terms) * (1 - 1e-12)).astype(np.int64)
        most = np.where(tf == MOST, FULL, 1_000_000_000 * tf // (1000 * tf + 8 * length[doc]))
        sketch = np.zeros((len(size), len(matrix)))
        sketch[doc, column] = most
        yield lo, sketch @ matrix


def _rows(query_no: np.ndarray, doc: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_no.astype(np.int32)), pa.array(doc), pa.array(bound.astype(np.int64))], ["q", "doc_id", "bound"]
    )


def greatest_bounds(sketches: DataFrame, corpus: Corpus, lookups: tuple, first: int = FIRST) -> DataFrame:
    """(q, doc_id, bound): the `first` documents of each task and query with the greatest bounds."""
    place, matrix = lookups

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, bounds = np.zeros((0, matrix.shape[1]), np.int64), np.zeros((0, matrix.shape[1]))
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for lo, found in upper_bounds(batch, corpus, place, matrix):
                own = np.repeat(ids[lo : lo + len(found), None], found.shape[1], 1)
                docs, bounds = np.concatenate([docs, own]), np.concatenate([bounds, found])
                if len(bounds) > first:
                    top = np.argpartition(-bounds, first - 1, axis=0)[:first]
                    docs, bounds = np.take_along_axis(docs, top, 0), np.take_along_axis(bounds, top, 0)
        at, q = np.nonzero(bounds)
        yield _rows(q, docs[at, q], bounds[at, q])

    return sketches.mapInArrow(probe, "q int, doc_id bigint, bound bigint")


def bounds_from(sketches: DataFrame, corpus: Corpus, lookups: tuple, thresholds: np.ndarray) -> DataFrame:
    """(q, doc_id, bound): every document whose bound reaches its query's threshold."""
    place, matrix = lookups

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for lo, found in upper_bounds(batch, corpus, place, matrix):
                at, q = np.nonzero(found >= thresholds)
                yield _rows(q, ids[lo + at], found[at, q])

    return sketches.mapInArrow(sift, "q int, doc_id bigint, bound bigint")


def exact_scores(docs: DataFrame, candidates: DataFrame, block: QueryBlock, weights: dict[bytes, int], corpus: Corpus, send: bool) -> DataFrame:
    """(q, doc_id, score) of the candidates (q, doc_id), from their whole texts; scores above 0 only."""
    wanted = candidates.groupBy("doc_id").agg(F.collect_set("q").alias("qs"))  # at most QUERIES numbers
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(wanted) if send else wanted, "doc_id")
    counts = [list(c.items()) for c in block.counts]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, qs in zip(*(batch.column(c) for c in ("doc_id", "text", "qs")), strict=True):
                held = Counter(terms(text.as_py()))
                length = corpus.length(held.total())
                worth = {w: weights[w] * impact(tf, length) for w, tf in held.items() if w in weights}
                out += [(q, doc.as_py(), sum(times * worth.get(w, 0) for w, times in counts[q])) for q in qs.as_py()]
            q, doc, value = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, pa.int64()), pa.array(value, pa.int64())], ["q", "doc_id", "score"])

    return rows.mapInArrow(score, "q int, doc_id bigint, score bigint").where("score > 0")


def _leading(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of each query with the greatest `by`, ties by doc_id, numbered from 1 in `rank`."""
    order = Window.partitionBy("q").orderBy(F.desc(by), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, sketches: DataFrame, block: QueryBlock, docs_with: dict[int, int], corpus: Corpus, store: Store, best: int) -> DataFrame:
    """(q, rank, doc_id, score) of one block of queries."""
    weights = {w: corpus.weight(docs_with.get(i, 0)) for i, w in enumerate(block.words)}
    lookups, n = block.lookups(weights), len(block.ids)
    named = sketches.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "buckets", "tops")
    thresholds, size, done = np.ones(n), FIRST, []
    first = greatest_bounds(named, corpus, lookups).groupBy("q", "doc_id").agg(F.max("bound").alias("bound"))
    left = None
    while True:
        known = first if left is None else left
        chosen = save_lean(store, _leading(known, "bound", size).select("q", "doc_id", "bound"), f"chosen-{len(done)}")
        send = n * size <= SENT
        done.append(save_lean(store, exact_scores(docs, chosen, block, weights, corpus, send), f"scored-{len(done)}"))
        found = done[0]
        for more in done[1:]:
            found = found.unionByName(more)
        leaders = _leading(found, "score", best)
        for r in leaders.where(F.col("rank") == best).select("q", "score").collect():  # one row per query
            thresholds[r.q] = r.score
        if left is None:  # the first block only looked for a threshold; all that reaches it comes now
            reach = bounds_from(named, corpus, lookups, thresholds).groupBy("q", "doc_id").agg(F.max("bound").alias("bound"))
            rest = reach.join(chosen.select("q", "doc_id"), ["q", "doc_id"], "left_anti")
        else:
            limits = docs.sparkSession.createDataFrame([(q, int(t)) for q, t in enumerate(thresholds)], "q int, least bigint")
            rest = left.join(F.broadcast(limits), "q").where("bound >= least").drop("least")
            rest = rest.join(chosen.select("q", "doc_id"), ["q", "doc_id"], "left_anti")
        before = left is not None
        left = save_lean(store, rest, f"left-{len(done)}")
        if before:
            store.drop(f"left-{len(done) - 1}")
        if left.isEmpty():
            return leaders
        size *= GROWTH


def ranked_search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item with a score above 0.

    The score of an item's term in a document is w * ((10^9 tf) div (1000 tf + 8 m)), with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L; an item's terms count with
    repeats. Equal scores are ordered by doc_id. Null and empty texts have no terms and are in no
    result; items without terms have none. A repeated item (same id and text) asks once, a
    repeated document is found as often as it is there. Documents without an id count in the
    statistics but can't be named, so they aren't returned.
    """
    spark = docs.sparkSession
    store = Store(spark, "ranked-search")
    results, sketches, corpus = [], None, None
    for number, block in enumerate(query_blocks(items)):
        tag = f"index-{number}"
        indexed = save_lean(store, index_documents(docs, block.hashes, sketches is None), tag, ARROW_ROWS)
        if sketches is None:
            sketches = indexed.where("term IS NULL")
            n_docs, n_terms = sketches.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
            corpus = Corpus(n_docs, n_terms or 0)
        with_term = indexed.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("docs"))
        docs_with = {r.term: r.docs for r in with_term.collect()}  # the terms of one block
        if not corpus.n_docs:
            break
        part = Store(spark, f"ranked-search-{number}")
        found = search_block(docs, sketches, block, docs_with, corpus, part, best)
        ids = spark.createDataFrame(list(enumerate(block.ids)), "q int, item_id bigint")
        named = found.join(F.broadcast(ids), "q").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        results.append(save_lean(store, named, f"found-{number}"))
        part.keep_only()
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for rows in results:
        out = out.unionByName(rows)
    store.keep_only(*(f"found-{n}" for n in range(len(results))))
    return out


_SQL_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS.format(text="coalesce(text, '')")} AS t FROM documents),
lengths AS (SELECT doc_id, len(t) AS n_own FROM d),
corpus AS (SELECT count(*) FILTER (n_own > 0) AS n_docs, sum(n_own)::BIGINT AS n_terms FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_SQL_TERMS.format(text="text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n_own * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op11_max_sketches", SQL)
def op11_max_sketches(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
