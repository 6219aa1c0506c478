"""Exact deduplication, the shingle join and repeated strings."""

import hashlib
import os
import random

import pyarrow as pa
import pytest
from helpers import DOCS, awkward, empty, jaccard_links, words
from pyspark.sql import functions as F

from corepart.llm import exact_dedup, jaccard_join, radix_repeats
from corepart.store import Store


def test_exact_dedup_awkward_rows(spark):
    rows = exact_dedup.exact_dedup(awkward(spark)).collect()
    assert len(rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.keep_id, r.group_size, r.kept) for r in by[1] + by[2]] == [(2, 2, False), (2, 2, True)]
    assert sorted(r.kept for r in by[3]) == [False, True]  # repeated rows leave one
    assert all(r.keep_id == 5 and r.group_size == 3 for r in by[4] + by[5])  # null and empty
    assert by[5][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(r.kept for r in rows) == 9


def test_exact_dedup_tells_colliding_digests_apart(spark):
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id bigint, text string")
    store = Store(spark, "test-collide")
    rows = exact_dedup.located(docs, store, False)
    weak = exact_dedup.dedup_groups(rows, store, digest=lambda t: F.encode(F.lit("same"), "utf-8"))
    got = {(r.doc_id, r.n, r.keep.doc_id) for r in weak.collect()}
    assert got == {(i, 8, 35 + i % 5) for i in range(40)}


def arrived(spark, lo, hi):
    digest = F.encode(F.lit("a"), "utf-8").alias("digest")
    return spark.range(lo, hi).select(digest, F.col("id").alias("doc_id"), F.lit("f").alias("file"), F.col("id").alias("row"))


def test_exact_dedup_state_continues(spark):
    state = exact_dedup.DedupState(Store(spark, "test-state"))
    for lo, hi in ((0, 3), (2, 6)):
        state.absorb(arrived(spark, lo, hi), f"from-{lo}")
    (row,) = state.table().collect()
    assert (row.n, row.keep.doc_id) == (7, 5)
    state.absorb(arrived(spark, 2, 6), "from-2")
    assert state.table().first().n == 7 and state.arrivals().count() == 7


def test_exact_dedup_batch_that_died_counts_once(spark):
    state = exact_dedup.DedupState(Store(spark, "test-dead"))
    state.write_batch(arrived(spark, 0, 3), "first")  # and no stream after it
    state.absorb(arrived(spark, 0, 3), "first")
    assert state.table().first().n == 3
    spark.range(1).write.parquet(state.store.path("arrivals/torn"))
    os.remove(state.store.path("arrivals/torn").removeprefix("file:") + "/_SUCCESS")
    with pytest.raises(ValueError, match="torn"):
        state.absorb(arrived(spark, 5, 6), "later")


def test_exact_dedup_empty_and_kept_columns(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    docs = awkward(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 9


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd = random.Random(5)
    base = [[f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(3, 90))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(9):
            copy = list(b)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(400)}"
            texts.append(" ".join(copy))
    texts += ["", None, "??", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs).collect()}
    distinct = list(dict.fromkeys(t or "" for t in texts))
    links, root = jaccard_links(distinct)
    first = {t: min(i for i, u in enumerate(texts) if (u or "") == t) for t in distinct}
    for i, t in enumerate(texts):
        k = distinct.index(t or "")
        least = min(first[distinct[j]] for j in range(len(distinct)) if root[j] == root[k])
        assert (got[i].class_id, got[i].n_links, got[i].copy_of) == (least, links[k], first[t or ""]), t


def test_jaccard_join_awkward_rows(spark):
    docs = awkward(spark)
    rows = jaccard_join.jaccard_join(docs).collect()
    assert len(rows) == 14
    by = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert by[1] == by[2] == by[3] == by[9] == (1, 2) and by[7] == by[8] == (7, 0) and by[4] == by[5] == (4, 0)
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 10, 11]
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_joined_units_have_wide_offsets():
    parts = [pa.RecordBatch.from_pydict({"text": ["a", None], "data": [b"x", b"yy"], "n": [i, 2]}) for i in range(3)]
    unit = jaccard_join._joined(parts)
    assert unit.num_rows == 6 and unit.to_pylist() == [r for p in parts for r in p.to_pylist()]
    assert unit.schema.types == [pa.large_string(), pa.large_binary(), pa.int64()]  # 2 GiB of text stay one batch


def test_posterior_bounds():
    assert jaccard_join.fewest_matches(0.8, 1e-6) == tuple(sorted(jaccard_join.fewest_matches(0.8, 1e-6)))
    assert jaccard_join.fewest_matches(0.8, 0.5)[-1] > jaccard_join.fewest_matches(0.8, 1e-6)[-1]


def brute_repeats(rows, length=50):
    """rows (doc_id, text): what is left, by comparing every string with all of smaller ids."""
    rows = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    least: dict = {}
    for d, b in rows:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, b in rows:
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < d:
                mark[s : s + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(docs, **options):
    rows = radix_repeats.remove_repeats(docs, **options).collect()
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("small", [False, True])
def test_repeats_against_brute_force(spark, monkeypatch, small):
    if small:  # pieces, hot groups and buckets that split
        monkeypatch.setattr(radix_repeats, "PIECE", 64)
        monkeypatch.setattr(radix_repeats, "SORTED", 8)
    rnd = random.Random(7)
    passages = ["".join(rnd.choice("abcd é") for _ in range(n)) for n in (49, 50, 51, 120, 300)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("abcd é") for _ in range(rnd.randrange(90))) for _ in range(4)]
        rows.append((rnd.choice([i, i, i, 7, None]), "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, "a" * 60), (104, "x" + "a" * 49)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert repeats(docs) == sorted(brute_repeats(rows))


@pytest.mark.parametrize("n", [2, 5, 25])
def test_hot_seed_at_the_right_edge_of_its_runs(monkeypatch, n):
    monkeypatch.setattr(radix_repeats, "SORTED", 2)  # one hot seed alone in its batch
    rnd = random.Random(n)
    common = rnd.randbytes(n + 49)
    rows = []
    for i in range(20):
        left = rnd.randrange(min(n, 3))  # so many bytes differ from document to document
        rows.append((7, i, 0, 100, n, rnd.randbytes(left) + common[left:], 26))
    want, seen = set(), set()
    for _, i, _, at, _, data, place in rows:
        for j in range(n):
            if 0 <= place - j <= 26 and data[j : j + 50] in seen:
                want.add((i, at + j, at + j + 50))
        seen |= {data[j : j + 50] for j in range(n)}
    assert want
    got = [r for b in radix_repeats._compared(50)(iter([radix_repeats._runs(rows)])) for r in b.to_pylist()]
    assert {(r["id"], r["lo"], r["hi"]) for r in got} == want


def test_repeats_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert repeats(docs) == sorted(brute_repeats(rows))
    assert radix_repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_kept_bytes(spark):
    passage = words(0, 30)
    docs = spark.createDataFrame([(1, passage), (2, f"before {passage} after")], DOCS.split(", lang")[0])
    by = {r.doc_id: bytes(r.kept) for r in radix_repeats.remove_repeats(docs).collect()}
    assert by == {1: passage.encode(), 2: b"before  after"}
