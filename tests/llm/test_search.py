"""Ranked search, nearest neighbours and the prefix trie, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F

from corepart.llm import euler_tour, learned_partitions, max_sketches

SF = "/root/testdata/sf0.001"


# --- ranked search ---------------------------------------------------------------------


def brute_ranking(docs, items, best=10):
    """Of (doc_id, text) rows and (item_id, text) rows."""
    counts = [(d, Counter(max_sketches.terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for d, c in counts:
            score = 0
            for w in max_sketches.terms(text):
                if c[w]:
                    m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


def ranking(docs, items):
    return sorted(map(tuple, max_sketches.ranked_search(docs, items).collect()), key=repr)


def test_terms():
    assert max_sketches.terms("It's ÉTÉ_x 3.5\x00Straße") == [w.encode() for w in ("it", "s", "ÉtÉ", "x", "3", "5", "straße")]
    assert max_sketches.terms(None) == max_sketches.terms("_ .") == []
    assert len(set(max_sketches.term_hashes([b"a", b"b", b"ab"]).tolist())) == 3


@pytest.mark.parametrize("small", [False, True])
def test_ranking_against_brute_force(spark, monkeypatch, small):
    if small:  # few buckets, so that bounds are loose; several rounds, blocks of queries and slices
        monkeypatch.setattr(max_sketches, "BUCKETS", 16)
        monkeypatch.setattr(max_sketches, "FIRST", 2)
        monkeypatch.setattr(max_sketches, "GROWTH", 2)
        monkeypatch.setattr(max_sketches, "QUERIES", 3)
        monkeypatch.setattr(max_sketches, "SENT", 4)
        monkeypatch.setattr(max_sketches, "CELLS", 64)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    pick = lambda n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(80)], k=n))
    docs = [(i, pick(rnd.randrange(1, 60))) for i in range(150)] + [(200 + i, "w3 w3 w70 W9") for i in range(25)]
    docs += [(300, None), (301, ""), (302, "_"), (None, "w70 w71"), (303, "w5 " * 400), (7, "w60 w61"), (7, "w60 w61")]
    items = [(i, pick(rnd.randrange(1, 12))) for i in range(7)] + [(20, "w3 w70"), (20, "w3 w70"), (21, "nowhere"), (22, None), (23, ""), (None, "w1")]
    got = ranking(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string"))
    assert got == brute_ranking(docs, items)
    assert [r[2] for r in sorted(r for r in got if r[0] == 20)] == list(range(200, 210))  # equal scores by id


def test_bounds_are_never_below_scores(spark, monkeypatch):
    monkeypatch.setattr(max_sketches, "BUCKETS", 8)
    block = max_sketches.QueryBlock([(1, "a b b c"), (2, "d zz")])
    rows = [(1, "a a b c d e f"), (2, "b " * 300 + "x y"), (3, "c"), (4, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    indexed = max_sketches.index_documents(docs, block.hashes).toArrow().combine_chunks()
    sketches = indexed.filter(indexed.column("term").is_null()).combine_chunks().to_batches()[0]
    corpus = max_sketches.Corpus(4, int(sum(sketches.column("n").to_pylist())))
    weights = {w: 100 * (i + 1) for i, w in enumerate(block.words)}
    ((_, bounds),) = max_sketches.upper_bounds(sketches, corpus, *block.lookups(weights))
    texts = dict(rows)
    for d, row in zip(sketches.column("doc_id").to_pylist(), bounds, strict=True):
        held = Counter(max_sketches.terms(texts[d]))
        for q, bound in enumerate(row):
            score = sum(times * weights[w] * max_sketches.impact(held[w], corpus.length(held.total())) for w, times in block.counts[q].items() if held[w])
            assert bound >= score


def test_ranking_of_awkward_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "w01 w02 other"), (2, "one")], "item_id bigint, text string")
    docs = awkward(spark)
    assert ranking(docs, items) == brute_ranking([(r.doc_id, r.text) for r in docs.collect()], [(1, "w01 w02 other"), (2, "one")])
    assert ranking(empty(spark), items) == []
    assert ranking(docs, items.limit(0)) == []


# --- nearest neighbours ----------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, part int"


def brute_nearest(rows, queries, best=5):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    out = {}
    for q in queries:
        found = sorted((-float(unit[q] @ unit[i]), i) for i in x if i != q)
        out[q] = found[:best]
    return out


def test_recall_on_the_supplied_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got: dict = {}
    for r in learned_partitions.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in found}
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(found, found[1:], strict=False))
        hits += len({r.vec_id for r in found} & {i for _, i in want[q]})
    assert hits / (5 * len(want)) >= 0.9


def test_nearest_with_copies_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "CELL", 16)  # several cells in a part, of vectors and of queries
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rnd.normal(size=8)).astype(np.float32).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(80)]  # copies of one vector
    bad = [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] + [1.0] * 7, 0), (2003, [float("inf")] * 8, 0), (2004, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (2005, [], 0)]
    vectors = spark.createDataFrame(rows + bad, VECTORS).repartition(5)
    got = learned_partitions.nearest(vectors, vectors.where("vec_id % 50 = 0 OR vec_id >= 2000"), cover=1.0).collect()
    want = brute_nearest([r[:2] for r in rows], [r[0] for r in rows if r[0] % 50 == 0])
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)
    near = sum(len({v for _, v, _ in by[q]} & {i for _, i in want[q]}) for q in want) / (5 * len(want))
    assert near > 0.97
    assert [v for _, v, _ in sorted(by[0])] == [1000, 1001, 1002, 1003, 1004]  # ties to the smaller id
    assert all(abs(s - 1) < 1e-12 for _, _, s in by[0])


def test_nearest_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, [1.0, 1.0], 1), (7, [0.0, -2.0], 1), (7, [0.0, -2.0], 1)], VECTORS)
    rows = learned_partitions.nearest(few, few.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows) == [(0, 1, 50), (0, 2, 7), (0, 3, 7), (50, 1, 0), (50, 2, 7), (50, 3, 7)]
    none = few.limit(0)
    assert learned_partitions.nearest(none, none).count() == 0
    assert learned_partitions.nearest(few.limit(1), few.limit(1)).count() == 0
    one = few.where("vec_id = 0")
    assert learned_partitions.nearest(one, one).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rnd = np.random.default_rng(5)
    x = np.repeat(rnd.normal(size=(8, 16)), 50, 0) + 0.05 * rnd.normal(size=(400, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = learned_partitions.neighbour_graph(unit, 10)
    start = rnd.permutation(np.arange(400) % 8)
    label = learned_partitions.balanced_parts(near, start, 8, slack=1.3)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.3 * 50)
    cut = lambda label: (label[near] != label[:, None]).mean()
    assert cut(label) < 0.6 * cut(start)


# --- prefix trie -----------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, d int"


def brute_trie(rows):
    """Of (conv_id, turn, role, text) rows."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members: dict = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append((c, d == len(built)))
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = sum(saved[c] for c in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, held in members.items():
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        ends = ",".join(str(c) for c in sorted(c for c, end in held if end))
        out.append((min(c for c, _ in held), len(node), parent, len(held), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 0) for r in rows], TURNS).repartition(6)
    out = euler_tour.prefix_trie(docs, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_brute_force(spark, monkeypatch, small):
    rnd = random.Random(6)
    rows = []
    for c in rnd.sample(range(400), 160):
        rows += [(c, t, rnd.choice(["user", "bot"]), rnd.choice(["a", "bb", "é", "", None])) for t in range(rnd.randrange(1, 14))]
    rows += [(3, t, "user", f"long {t % 7}") for t in range(300)]  # one long conversation
    rows += [(7, 2, "bot", "tie"), (7, 2, "bot", "tie"), (7, 2, None, "tie"), (7, None, "user", "first"), (None, 1, "user", "nobody")]
    rows += [(500 + 5 * i, t, "user", "same") for i in range(60) for t in range(3)]  # copies
    options = {"block": 8, "few": 12} if small else {}
    if small:
        monkeypatch.setattr(euler_tour, "IDS", 4)
    assert trie(spark, rows, **options) == brute_trie(rows)


def test_trie_of_empty_and_turnless(spark):
    assert trie(spark, []) == [] == trie(spark, [(None, 1, "user", "x")])
    lonely = next(c for c in range(6, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lonely, 0, "user", "gone")]  # its base is not there, and its own turn is within the first h
    assert trie(spark, rows) == brute_trie(rows) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_list_ranking_in_rounds(spark):
    from corepart.store import Store

    n, rnd = 3000, random.Random(8)
    order = rnd.sample(range(n), n)
    rows = [(x, order[i - 1] if i else None, i % 7 if i else 0, 1 if i else 0) for i, x in enumerate(order)]
    items = spark.createDataFrame(rows, "id bigint, ahead bigint, leaf bigint, saving bigint")
    out = euler_tour.rank_list(items, Store(spark, "test-rank"), few=100)
    assert {r.id: r.saving for r in out.collect()} == {x: i for i, x in enumerate(order)}


def test_conversation_across_partitions(spark):
    """A third of all turns are of one conversation: no task holds them all."""
    rows = [(4, t, "user", f"t{t}") for t in range(2000)] + [(10 + c, t, "user", f"t{t}") for c in range(400) for t in range(10)]
    turns = euler_tour.turn_rows(spark.createDataFrame([(*r, 0) for r in rows], TURNS))
    from corepart.store import Store

    store = Store(spark, "test-across")
    spread = euler_tour.along_conversations(turns.repartition(4), ["turn", "a", "b"], store, "x")
    got = spread.where("conv_id = 4").agg(F.count_distinct("d"), F.max("d"), F.count_distinct("pa", "pb")).first()
    assert tuple(got) == (2000, 2000, 2000)
    shared = spread.where("d = 10 AND conv_id <> 4").select("pa", "pb").union(spread.where("d = 10 AND conv_id = 4").select("pa", "pb"))
    assert shared.distinct().count() == 1  # equal beginnings have equal hashes
