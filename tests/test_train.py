"""Gradients, training runs, resuming, alignment."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corepart.operators import align, buckets, sage, walks
from corepart.plans import embed
from corepart.store import Store


def blocks_of(rng, n, f, d):
    return rng.normal(size=(n, 2 * d)), rng.normal(size=(n, f, 2 * d)), rng.integers(0, f + 1, n)


def test_gradient_agrees_with_finite_differences():
    rng = np.random.default_rng(1)
    d, hidden, n, f = 3, 4, 5, 2
    params = sage.init_params(d, hidden, 0)
    params = params + rng.normal(0, 0.1, params.size)
    own, near, k = blocks_of(rng, n, f, d)
    drop = sage.dropout_mask(np.arange(n), 1 + f, hidden, 0.5, 3)
    weight = rng.normal(size=(n, hidden))
    loss = lambda p: (sage.forward(p, own, near, k, drop)[0] * weight).sum()
    grad = sage.backward(sage.forward(params, own, near, k, drop)[1], weight, drop)
    for i in range(params.size):
        step = np.zeros_like(params)
        step[i] = 1e-6
        assert grad[i] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-6, abs=1e-5)


def test_a_batch_agrees_with_finite_differences(monkeypatch):
    monkeypatch.setattr(sage, "CHUNK", 2)
    rng = np.random.default_rng(2)
    d, hidden, f, n = 2, 3, 2, 6
    own, near = rng.normal(size=(n, 2 * d)).astype("float32"), rng.integers(-1, n, (n, f))
    near = -np.sort(-near, axis=1)  # -1 beyond the end of a list
    blocks, set_ = sage.Blocks(np.arange(n) + 50, own, near), sage.Training(d, hidden, f, 0.3, 0.1, 10, (1, 2))
    params = sage.init_params(d, hidden, 4)
    pairs = np.array([(0, 1, 2), (1, 2, 3), (0, 5, 0), (4, 4, 1)])
    grad, loss = sage.batch_gradient(params, blocks, pairs, set_, 11)

    def direct(p):
        out = sage.forward(p, *blocks.chunk(np.arange(n), set_, 11))[0]
        return sum(np.logaddexp(0, -out[s] @ out[t]) + np.logaddexp(0, out[s] @ out[g]) for s, t, g in pairs)

    assert loss == pytest.approx(direct(params))
    for i in range(params.size):
        h = np.zeros_like(params)
        h[i] = 1e-6
        assert grad[i] == pytest.approx((direct(params + h) - direct(params - h)) / 2e-6, abs=1e-5)


def test_shards_step_alone_and_are_averaged_by_their_pairs(spark):
    rng = np.random.default_rng(6)
    d, hidden, f = 2, 3, 2
    set_ = sage.Training(d, hidden, f, 0.0, 0.1, 2, (1, 0))
    own = {(p, i): rng.normal(size=2 * d).astype("float32") for p in (1, 2) for i in range(5)}
    lists = {(p, i): sorted(rng.choice(5, rng.integers(1, 3), replace=False).tolist()) for p in (1, 2) for i in (0, 1, 3)}
    owns = spark.createDataFrame([(*k, v.tolist()) for k, v in own.items()], "part int, id bigint, own array<float>")
    near = spark.createDataFrame([(*k, v) for k, v in lists.items()], "part int, id bigint, near array<bigint>")
    rows = [(p, s, int(o), *rng.integers(0, 5, 3).tolist()) for p in (1, 2) for s in (0, 1) for o in range(2 + s)]
    table = spark.createDataFrame(rows, "part int, shard int, ord bigint, src bigint, dst bigint, neg bigint").repartition(3)
    states = {p: np.stack([sage.init_params(d, hidden, p), *np.zeros((2, sage.init_params(d, hidden, p).size))]) for p in (1, 2)}
    shared = spark.sparkContext.broadcast(states)
    got = sage.averaged(sage.train_shards(sage.shard_rows(table, owns, near), shared, {1: 0, 2: 4}, set_))
    for p in (1, 2):
        places = np.full((5, f), -1)
        for i in range(5):
            places[i, : len(lists.get((p, i), []))] = lists.get((p, i), [])
        blocks = sage.Blocks(np.arange(5), np.stack([own[p, i] for i in range(5)]), places)
        want, n, steps = 0.0, 0, 0
        for s in (0, 1):
            own_rows = np.array([r[3:] for r in sorted(rows) if r[:2] == (p, s)])
            state, step, _ = sage.local_steps(states[p], {1: 0, 2: 4}[p], blocks, own_rows, set_, s)
            want, n, steps = want + len(own_rows) * state, n + len(own_rows), steps + len(own_rows) * step
        assert np.allclose(got[p][0], want / n) and got[p][1] == round(steps / n) and got[p][3] == n


def test_dropout_depends_on_the_vertex_only():
    ids = np.arange(1000)
    a = sage.dropout_mask(ids, 3, 8, 0.25, 5)
    b = sage.dropout_mask(ids[::-1].copy(), 3, 8, 0.25, 5)
    assert (a == b[::-1]).all() and (a != sage.dropout_mask(ids, 3, 8, 0.25, 6)).any()
    assert a.mean() == pytest.approx(1.0, abs=0.02) and set(np.unique(a)) == {0.0, 1 / 0.75}


@pytest.fixture(scope="module")
def clusters(spark):
    """Two parts; in each, two groups of vertices with edges inside the groups only."""
    rows = []
    for part in (1, 2):
        for g in (0, 10):
            rows += [(part, g + i, g + j) for i in range(8) for j in range(8) if i != j]
    return Store(spark, "clusters").save(spark.createDataFrame(rows, "part int, src bigint, dst bigint"), "edges")


@pytest.fixture(scope="module")
def feats(spark):
    rng = np.random.default_rng(2)
    rows = [(g + i, [float(g == 0), float(g == 10), *rng.normal(0, 0.3, 2).tolist()]) for g in (0, 10) for i in range(8)]
    return spark.createDataFrame(rows, "id bigint, feat array<double>").cache()


def separation(emb):
    """Mean dot product inside groups minus across groups, per part."""
    out = {}
    for part in (1, 2):
        rows = {r.id: np.array(r.vec) for r in emb.where(F.col("part") == part).collect()}
        same, other = [], []
        for a in rows:
            for b in rows:
                if a < b:
                    (same if (a < 10) == (b < 10) else other).append(rows[a] @ rows[b])
        out[part] = np.mean(same) - np.mean(other)
    return out


def test_graph_layers_learn(clusters, feats):
    history = []
    emb = embed.embed_parts(
        clusters, "sage", feats, dim=8, epochs=4, batch_size=60, dropout=0.0, lr=0.05, seed=1, history=history
    )
    assert emb.count() == 32
    for part in (1, 2):
        losses = [h["loss"] for h in history if h["part"] == part]
        assert np.mean(losses[-2:]) < np.mean(losses[:2])
    assert min(separation(emb).values()) > 0


def test_skip_gram_learns(clusters):
    emb = embed.embed_parts(
        clusters, "walks", dim=8, epochs=6, batch_size=100, lr=0.2, seed=1, init_scale=0.3, negatives=2
    )
    assert emb.count() == 32
    assert min(separation(emb).values()) > 0


def test_rotating_buckets_and_slots_learn(clusters):
    rows = 4 * 8 * 8 * 3  # four vectors in a bucket, four buckets
    for options in ({"bucket_bytes": rows}, {"bucket_bytes": rows, "slot": 3}):
        emb = embed.embed_parts(clusters, "walks", dim=8, epochs=3, batch_size=25, lr=0.2, seed=1, init_scale=0.3, negatives=2, **options)
        assert emb.select("part", "id").distinct().count() == emb.count() == 32
        assert min(separation(emb).values()) > 0


def test_every_two_buckets_meet_once():
    for b in range(1, 9):
        met = []
        for r in range(b):
            pairs = {tuple(sorted((i, (r - i) % b))) for i in range(b)}
            assert sorted(i for p in pairs for i in set(p)) == list(range(b))  # no bucket twice in a round
            met += pairs
        assert sorted(met) == [(i, j) for i in range(b) for j in range(i, b)]


def test_jobs_do_not_depend_on_the_number_of_pairs(spark, clusters):
    def jobs(times, method):
        more = clusters.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
        pairs = more.select("part", F.concat_ws(":", "src", "dst", "k").alias("pair"), "src", "dst")
        spark.sparkContext.setJobGroup(f"jobs-{method}-{times}", "")
        if method == "skip_gram":
            embed.skip_gram(pairs, clusters, dim=4, batch_size=10)
        else:
            feats = clusters.select("part", F.col("src").alias("id")).distinct().withColumn("feat", F.array(F.lit(1.0), F.col("id") / 10))
            embed.train_sage(pairs, clusters, feats, hidden=4, batch_size=10)
        spark.sparkContext.setJobGroup("other", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"jobs-{method}-{times}"))

    for method in ("skip_gram", "sage"):
        few, many = jobs(2, method), jobs(20, method)
        assert abs(many - few) <= 3  # adaptive execution may add a stage's job


def test_state_of_another_run_is_refused(spark, clusters):
    path = Store(spark, "refuse-test").root
    opts = {"dim": 4, "batch_size": 200, "seed": 5, "state_path": path}
    embed.embed_parts(clusters, "walks", **opts)
    for other in ({"dim": 8}, {"batch_size": 100}, {"seed": 6}):
        with pytest.raises(ValueError, match="another run"):
            embed.embed_parts(clusters, "walks", **{**opts, **other})
    with pytest.raises(ValueError, match="another run"):  # other edges
        embed.embed_parts(clusters.where("src <> 3"), "walks", **opts)
    nameless = Store(spark, "refuse-test")
    nameless.save(spark.range(1), "epoch=0")
    with pytest.raises(ValueError, match="does not say"):
        embed.embed_parts(clusters, "walks", dim=4, state_path=nameless.root)


def test_two_tables(clusters):
    emb = embed.embed_parts(clusters, "edges", dim=4, batch_size=500, seed=3)
    assert emb.select("part", "id").distinct().count() == emb.count() and emb.count() > 20


@pytest.mark.parametrize("method", ["walks", "sage"])
def test_resumed_equals_uninterrupted(spark, clusters, feats, method):
    path = Store(spark, "resume-test").root
    opts = {"dim": 4, "batch_size": 200, "seed": 5, "feats": feats}
    embed.embed_parts(clusters, method, state_path=path, epochs=1, **opts)
    resumed = embed.embed_parts(clusters, method, state_path=path, epochs=2, **opts)
    whole = embed.embed_parts(clusters, method, epochs=2, **opts)
    a = {(r.part, r.id): r.vec for r in resumed.collect()}
    b = {(r.part, r.id): r.vec for r in whole.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-7)


def test_a_function_as_method(spark, clusters):
    fixed = spark.createDataFrame([(1, 1, [1.0])], "part int, id bigint, vec array<double>")
    assert embed.embed_parts(clusters, lambda e: fixed).first().vec == [1.0]
    with pytest.raises(ValueError, match="unknown"):
        embed.embed_parts(clusters, "other")


def linear_parts(spark, n_core, d=4):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, d))
    maps = [np.eye(d), rng.normal(size=(d, d)), rng.normal(size=(d, d))]
    rows = []
    for i in range(40):
        parts = range(3) if i < n_core else [0] if i < 28 else [1 + i % 2]
        rows += [(p, i, (base[i] @ maps[p]).tolist()) for p in parts]
    return base, spark.createDataFrame(rows, "part int, id bigint, vec array<double>")


def test_alignment_recovers_a_linear_image(spark):
    base, emb = linear_parts(spark, 10)
    got = {r.id: r.vec for r in align.merge_embeddings(emb, 3).collect()}
    assert len(got) == 40
    for i, v in got.items():
        assert v == pytest.approx(base[i], abs=1e-9)


def test_alignment_needs_enough_core_rows(spark):
    _, emb = linear_parts(spark, 3)
    with pytest.raises(ValueError, match="core rows"):
        align.merge_embeddings(emb, 3)
    assert align.merge_embeddings(emb, 3, ridge=1e-3).count() == 40
    _, none = linear_parts(spark, 0)
    with pytest.raises(ValueError, match="no core"):
        align.merge_embeddings(none, 3)


def test_a_vertex_in_some_parts_is_kept_once_per_part(spark):
    _, emb = linear_parts(spark, 10)
    extra = emb.where("part = 1 and id < 1").select(F.lit(2).alias("part"), F.lit(99).cast("bigint").alias("id"), "vec")
    both = emb.unionByName(extra).unionByName(extra.withColumn("part", F.lit(1)))
    assert align.merge_embeddings(both, 3).where("id = 99").count() == 2
    once = align.merge_embeddings(both, 3, dedupe=True).where("id = 99").collect()
    assert [r.part for r in once] == [1]


def test_anchor_tie_goes_to_the_lowest_part(spark):
    emb = spark.createDataFrame([(p, i, [1.0]) for p in (3, 2) for i in range(4)], "part int, id bigint, vec array<double>")
    assert align.anchor_part(emb).first().part == 2


def test_loss_of_scores(spark):
    pos = spark.createDataFrame([(0.0,), (800.0,)], "score double")
    neg = spark.createDataFrame([(0.0,), (-800.0,)], "score double")
    assert sage.link_loss(pos, neg).first().loss == pytest.approx(np.log(2) / 2)


def test_units_of_a_round_have_tasks_of_their_own():
    counts, most = {1: 4, 2: 1, 3: 7}, {1: 3}
    for r in range(7):
        first, n = buckets.first_units(counts, most, r)
        taken = []
        for part, b in counts.items():
            for lo, hi in {tuple(sorted((i, (r - i) % b))) for i in range(b)} if b > r else ():
                pair = lo if lo <= r else lo - (r - r // 2)
                taken += [first[part] + pair * most.get(part, 1) + slot for slot in range(most.get(part, 1))]
        assert sorted(taken) == list(range(n))


def test_steps_take_as_long_with_more_vectors_and_copies_are_averaged():
    rng = np.random.default_rng(4)
    ids = rng.permutation(50) * 3
    vectors = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(np.zeros(50, np.int64)), pa.array(np.where(ids < 60, 2.0, 5.0)), buckets._rows(np.zeros((50, 6)) + [1, 2, 0, 0, 0, 0])],
        ["src", "dst", "y", "held"],
    )
    unit = buckets._Unit(1, 0, [vectors], 2)
    assert (unit.id[unit.places(ids, 0)] == ids).all()
    unit.step(unit.places(ids[:3], 0), unit.places(ids[3:6], 0), np.ones(3), 1.0, 0.1)
    (rows,) = unit.batches()
    t = dict(zip(rows.column("id").to_pylist(), rows.column("t").to_pylist(), strict=True))
    assert all(t[i] == (3 if i < 60 else 6) for i in ids) and rows.column("hits").to_numpy().sum() == 6
    touched = np.isin(unit.id, ids[:6])
    assert (unit.state[~touched] == [1, 2, 0, 0, 0, 0]).all() and (unit.state[touched] != [1, 2, 0, 0, 0, 0]).all()
    # two copies of a vector, in different batches: their mean by the steps
    batch = lambda i, x, hits: pa.RecordBatch.from_arrays(
        [pa.array([1], pa.int32()), pa.array([0], pa.int32()), pa.array([i]), *[buckets._rows(np.array([[x, x]]))] * 3, pa.array([int(x)]), pa.array([hits]), pa.array([0], pa.int32())],
        ["part", "role", "id", "vec", "m", "v", "t", "hits", "unit"],
    )
    got = [r for b in buckets._mean_of_copies(iter([batch(1, 4.0, 1), batch(1, 8.0, 3), batch(2, 5.0, 0), batch(2, 9.0, 0)])) for r in b.to_pylist()]
    assert [(r["id"], r["vec"], r["t"]) for r in got] == [(1, [7.0, 7.0], 8), (2, [5.0, 5.0], 9)]


def test_a_large_batch_is_scored_in_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    d, hidden, f, n = 2, 3, 2, 9
    blocks = sage.Blocks(np.arange(n), rng.normal(size=(n, 2 * d)).astype("float32"), np.full((n, f), -1))
    set_, params = sage.Training(d, hidden, f, 0.0, 0.1, 10, (1,)), sage.init_params(d, hidden, 4)
    pairs = rng.integers(0, n, (40, 3))
    whole = sage.batch_gradient(params, blocks, pairs, set_, 1)
    monkeypatch.setattr(sage, "PAIRS", 7)
    cut = sage.batch_gradient(params, blocks, pairs, set_, 1)
    assert np.allclose(whole[0], cut[0]) and whole[1] == pytest.approx(cut[1])


def test_blocks_are_shipped_once_for_as_many_pairs_as_vertices(spark, monkeypatch):
    """Shards of a part with 60 vertices and 900 pairs in batches of 4: 16 pairs each would ship all blocks 57 times."""
    rows = [(1, i, (i + k) % 60) for i in range(60) for k in range(1, 16)]
    edges = Store(spark, "shards-test").save(spark.createDataFrame(rows, "part int, src bigint, dst bigint"), "edges")
    feats = spark.range(60).select(F.lit(1).alias("part"), "id", F.array(F.lit(1.0), F.col("id") / 10).alias("feat"))
    pairs = edges.select("part", F.concat_ws(":", "src", "dst").alias("pair"), "src", "dst")
    seen, plain = [], sage.shard_rows

    def shard_rows(rows, *more):
        out = plain(rows, *more)
        seen.append(out.where("kind = 0").count())
        return out

    monkeypatch.setattr(sage, "shard_rows", shard_rows)
    embed.train_sage(pairs, edges, feats, hidden=2, batch_size=4, syncs=2)
    assert sum(seen) <= 60 * 16 + 60


def test_scores_carry_columns(spark):
    emb = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0])], "id bigint, feat array<double>")
    pairs = spark.createDataFrame([(1, 2, "a"), (2, 2, "b")], "src bigint, dst bigint, tag string")
    assert sorted(map(tuple, sage.edge_scores(pairs, emb, keep=("tag",)).collect())) == [(1, 2, "a", 5.0), (2, 2, "b", 10.0)]


def test_buckets_grow_with_pairs_where_slots_would_copy_many_vectors(spark):
    table = spark.createDataFrame([(1, i) for i in range(12)] + [(2, i) for i in range(3)], "part int, id bigint")
    size = 4 * 8 * 3 * 3  # three vectors of four numbers
    assert buckets.bucket_counts(table, 4, size) == {1: 4, 2: 1}
    assert buckets.bucket_counts(table, 4, size, {1: 80, 2: 10}, 10) == {1: 4, 2: 1}  # ten pairs between two buckets
    assert buckets.bucket_counts(table, 4, size, {1: 500, 2: 500}, 10) == {1: 10, 2: 3}
    assert buckets.bucket_counts(table, 4, size, {1: 500_000, 2: 500_000}, 1000) == {1: 4, 2: 1}  # few vectors: slots


def test_examples_are_packed_once_and_whole(spark):
    """Rounds get rows of many examples: each example once, with the buckets where its ends meet, in the order of ord."""
    rng = np.random.default_rng(8)
    n = {1: 3000, 2: 40}
    rows = [(p, int(rng.integers(-(1 << 63), (1 << 63) - 1)), *rng.integers(-9, 50, 2).tolist(), float(i % 2)) for p in n for i in range(n[p])]
    rows += [(1, rows[0][1], 5, 6, 0.0), (1, rows[0][1], 5, 6, 0.0)]  # equal in ord, and repeated
    n[1] += 2
    table = spark.createDataFrame(rows, "part int, ord bigint, src bigint, dst bigint, y double").repartition(3)
    counts = {1: 3, 2: 1}
    packed, slots = buckets.deal_examples(table, counts, Store(spark, "packed"), "rows", 100, n)
    held = packed.collect()
    assert len(held) < 800
    pieces, got, b = buckets.pieces_of(n, counts, 100), [], F.create_map(F.lit(1), F.lit(3), F.lit(2), F.lit(1))[F.col("part")]
    where = {(r.part, r.id): r.b for r in table.select("part", F.explode(F.array("src", "dst")).alias("id")).distinct().select("*", buckets.bucket("id", b).alias("b")).collect()}
    for r in held:
        src, dst, y = buckets.unpacked(pa.scalar(r.blob), r.n)
        assert r.n == len(src) == len(dst) == len(y) and 0 <= r.piece < pieces[r.part] and r.round == (r.lo + r.hi) % counts[r.part]
        assert all({where[r.part, s], where[r.part, t]} == {r.lo, r.hi} for s, t in zip(src.tolist(), dst.tolist(), strict=True))
        got += [(r.part, r.lo, r.hi, r.ord, i, s, t, v) for i, (s, t, v) in enumerate(zip(src.tolist(), dst.tolist(), y.tolist(), strict=True))]
    want = sorted((p, *sorted((where[p, s], where[p, t])), o, s, t, v) for p, o, s, t, v in rows)
    assert [(*g[:3], *g[5:]) for g in sorted(got)] == [(*w[:3], *w[4:]) for w in want]
    sizes = {}
    for w in want:
        sizes[w[:3]] = sizes.get(w[:3], 0) + 1
    assert {tuple(r) for r in slots.collect()} == {(*k, -(-v // 100)) for k, v in sizes.items() if v > 100}
    assert sum(buckets.round_tasks(n, counts, 12)[-1:]) >= 12 - len(counts)


def test_a_block_is_multiplied_once_a_pass(monkeypatch):
    """However many vertices have it as a neighbour: gathered once for the sums, once for their gradient."""

    class Counted:
        def __init__(self, values):
            self.values, self.rows = values, 0

        def __getitem__(self, places):
            self.rows += np.size(places)
            return self.values[places]

    monkeypatch.setattr(sage, "CHUNK", 4)
    rng = np.random.default_rng(5)
    d, hidden, f, n = 2, 3, 4, 12
    own = Counted(rng.normal(size=(n, 2 * d)).astype("float32"))
    blocks = sage.Blocks(np.arange(n), own, rng.integers(0, n, (n, f)))
    sage.batch_gradient(sage.init_params(d, hidden, 4), blocks, rng.integers(0, 9, (40, 3)), sage.Training(d, hidden, f, 0.5, 0.1, 40, (1,)), 1)
    assert own.rows <= 2 * n


def test_weights_of_negatives_are_made_once_a_run(spark, clusters, feats, monkeypatch):
    made, plain = [], walks.neg_weights

    def neg_weights(*args):
        made.append(1)
        return plain(*args)

    monkeypatch.setattr(walks, "neg_weights", neg_weights)
    embed.embed_parts(clusters, "sage", feats, dim=2, epochs=2, batch_size=1000, seed=1)
    assert len(made) == 1
