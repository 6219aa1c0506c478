"""Language, leaks, tokens, toxicity, mixing."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORDS, awkward, empty, words
from pyspark.sql import functions as F

from corepart.llm import centroid_language, leak_match, packed, poisson_mix, shingles, token_rollup, toxicity_chain
from corepart.store import Store


def speech(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rnd = random.Random(2)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schl", "ung", "eit", "ver"], "cc": ["ção", "lhe", "nha", "os"]}
    rows = [(i, speech(rnd, sounds[lang], 40), lang) for i, lang in enumerate(list(sounds) * 40)]
    return sounds, spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_on_held_out_texts(spark, languages):
    sounds, docs = languages
    model = centroid_language.learn_languages(docs)
    rnd = random.Random(3)
    fresh = [speech(rnd, sounds[lang], 12) for lang in sounds for _ in range(20)]
    langs, scores, rejected = model.judge(fresh)
    assert langs == [lang for lang in sounds for _ in range(20)]
    assert not rejected.any() and ((scores > 0) & (scores <= 1)).all()
    langs, scores, rejected = model.judge([None, "", "12 !!", "привет мир как дела сегодня " * 9])
    assert langs[:3] == ["und"] * 3 and list(scores[:3]) == [0, 0, 0] and rejected.all()


def test_language_pieces_count_as_the_whole(monkeypatch):
    text = "The quick brown fox, été — Straße! " * 50
    whole, _ = centroid_language.gram_counts(text)
    monkeypatch.setattr(centroid_language, "PIECE", 13)
    assert (centroid_language.gram_counts(text)[0] == whole).all()


def test_language_awkward_rows(spark, languages):
    model = centroid_language.learn_languages(languages[1])
    docs = awkward(spark)
    judged = centroid_language.identify(docs, model)
    assert judged.select("row.*").columns == docs.columns and judged.count() == 14
    none = centroid_language.learn_languages(empty(spark))
    assert {r.lang_pred for r in centroid_language.identify(docs, none).collect()} == {"und"}
    assert centroid_language.identify(empty(spark), model).count() == 0


@pytest.mark.parametrize("n", [2, 6, 40])
def test_language_of_texts_longer_than_all_learned_ones(spark, n):
    rnd = random.Random(5)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schl", "ung", "eit", "ver"]}
    rows = [(speech(rnd, sounds[lang], n), lang) for lang in list(sounds) * 60]
    model = centroid_language.learn_languages(spark.createDataFrame(rows, "text string, lang string"))
    long = [speech(rnd, sounds[lang], words) for lang in sounds for words in (150, 700)]
    langs, _, rejected = model.judge(long)
    assert langs == ["aa", "aa", "bb", "bb"] and not rejected.any()
    assert model.judge(["привет мир как дела сегодня " * 9])[2].all()


def test_language_matrix_holds_one_float_per_gram():
    rnd = random.Random(8)
    texts = [speech(rnd, ["ka", "to", "mi", "ra"], 30) for _ in range(centroid_language.ROWS)] + [None, "", "12 34"]
    idf = np.ones(centroid_language.DIM, np.float32)
    rows, sizes, found = centroid_language.log_counts(texts[:40])
    centres = centroid_language.cluster(centroid_language.unit_rows(rows, idf), 2)
    model = centroid_language.LanguageModel(idf, ["aa", "aa"], centres, np.full((2, 5), 2.0))
    model.judge(texts[:1])  # the table of letters is made once
    tracemalloc.start()
    langs, _, _ = model.judge(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * 4 * centroid_language.DIM * centroid_language.ROWS
    assert langs == ["aa"] * centroid_language.ROWS + ["und"] * 3 and found.all() and sizes.max() <= 4


def test_whole_rows_travel_once_and_leave_in_pieces(spark, languages):
    docs = spark.createDataFrame([(i, f"text number {i}", float(i)) for i in range(1300)], "doc_id bigint, text string, x double")
    model = centroid_language.learn_languages(languages[1])
    items = spark.createDataFrame([(1, "text number 77")], "item_id bigint, text string")
    judged, left = centroid_language.identify(docs, model), leak_match.without_leaks(docs, items)
    for out, name in ((judged, "row"), (left, "doc")):
        (line,) = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "MapInArrow" in x]
        assert line.count(f"({name}#") == 1 and "text#" not in line
    assert sorted(r.row.doc_id for r in judged.collect()) == list(range(1300))
    assert sorted((r.doc_id, r.text, r.x) for r in left.collect()) == [(i, f"text number {i}", float(i)) for i in range(1300) if i != 77]
    nested = docs.select("doc_id", F.struct("text").alias("in"))
    other = centroid_language.identify(nested, model, text="in.text").select("row.doc_id", "lang_pred", "score").collect()
    assert sorted(other) == sorted(judged.select("row.doc_id", "lang_pred", "score").collect())
    rows, at = packed.packed(docs.select("x", "text"), "row")
    kind = pa.struct([("x", pa.float64()), ("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([{"x": float(i), "text": str(i)} for i in range(1300)], kind)], ["row"])
    cut = list(packed.pieces(iter([batch.slice(3), batch.slice(0, 0)]), at))
    assert rows.columns == ["row"] and [p.num_rows for p, _ in cut] == [512, 512, 273]
    assert [t for _, texts in cut for t in texts.to_pylist()] == [str(i) for i in range(3, 1300)]


def test_language_sample_has_different_texts_despite_copies(spark):
    few, many = [f"few {i}" for i in range(20)], [f"many {i}" for i in range(3000)]
    rows = [(t, "aa") for t in few] + [(t, "bb") for t in many] + [(many[5], "cc")] * 3
    rows += [(few[0], "aa")] * 30000 + [(t, "bb") for t in many[:10]] * 3000
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    drawn = [(r.lang, r.text) for r in centroid_language.draw_sample(docs, 50).collect()]
    assert len(set(drawn)) == len(drawn)
    by = {lang: {t for k, t in drawn if k == lang} for lang in ("aa", "bb", "cc")}
    assert by["aa"] == set(few) and len(by["bb"]) == 50 and by["bb"] <= set(many) and by["cc"] == {many[5]}
    assert sorted(drawn) == sorted((r.lang, r.text) for r in centroid_language.draw_sample(docs.distinct(), 50).collect())


def edit_distance(p, t):
    row, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p[i - 1] != c)))
        row, best = new, min(best, new[-1])
    return best


def test_bit_parallel_distance():
    rnd = random.Random(1)
    for _ in range(500):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 90)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randrange(120)))
        assert leak_match.best_distance(p, t) == edit_distance(p, t)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    items = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(8, 30))) for _ in range(15)]
    texts = []
    for i in range(80):
        item = list(items[i % 15])
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(item))
            item[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "yy"])
        texts.append(f"{words(0, 9)} {''.join(item).upper()}, {words(3, 12)}" if i % 4 else words(10, 50))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in leak_match.leaks(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for n, item in enumerate(items):
            k = int(len(item) * leak_match.ERROR_RATE)
            distance = edit_distance(item, leak_match.normal(t))
            if distance <= k:
                want[d, n] = distance
    assert got == want
    kept = leak_match.without_leaks(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(80)) - {d for d, _ in want}


def test_leaks_awkward_rows(spark, monkeypatch):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, words(5, 25)), (1, words(5, 25)), (None, "one two"), (3, None), (4, ""), (5, "??")], "item_id bigint, text string")
    monkeypatch.setattr(leak_match, "BLOCK_CHARS", 1)  # a block for each item
    rows = leak_match.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in rows) == [(1, 1), (2, 1), (3, 1), (3, 1), (7, 0), (8, 0), (9, 1), (10, 1)]
    kept = leak_match.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == 6
    assert leak_match.leaks(docs, empty(spark, "item_id bigint, text string")).count() == 0
    assert leak_match.leaks(empty(spark), items).count() == 0


def test_word_shingles():
    docs = ["a b c d e f", None, "", "one", "!!", "A  B, c d-e f g", "été x", "z" * 50, " ".join(map(str, range(40)))]
    known: dict = {}
    for lo, hi, hashes, offsets in shingles.blocks(pa.array(docs)):
        for i in range(lo, hi):
            found = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (docs[i] or "").lower())
            tuples = [tuple(found[j : j + 5]) for j in range(max(len(found) - 4, 1 if found else 0))]
            own = hashes[offsets[i - lo] : offsets[i - lo + 1]]
            assert len(own) == len(tuples)
            assert all(known.setdefault(t, h) == h for t, h in zip(tuples, own, strict=True))
    assert len(set(known.values())) == len(known)


def rollup_rows(rollup):
    return sorted((r.source or "", r.lang or "", r.version, r.docs, r.tokens) for r in rollup.totals().collect())


def test_rollup_of_signed_batches(spark):
    docs = awkward(spark)
    counts = token_rollup.contributions(docs, "w", lambda: token_rollup.count_words).cache()
    rollup = token_rollup.TokenRollup(Store(spark, "test-rollup"))
    assert rollup_rows(rollup) == []
    assert rollup.commit("a", token_rollup.signed(after=counts))
    full = rollup_rows(rollup)
    assert sum(r[3] for r in full) == 14 and sum(r[4] for r in full) == sum(
        len((r.text or "").split()) for r in docs.select("text").collect()
    )
    assert not rollup.commit("a", token_rollup.signed(after=counts)) and rollup_rows(rollup) == full
    twice = counts.withColumn("tokens", F.col("tokens") * 2)
    rollup.commit("b", token_rollup.signed(counts, twice))
    assert [r[4] for r in rollup_rows(rollup)] == [2 * r[4] for r in full]
    rollup.compact()
    assert not rollup.commit("b", token_rollup.signed(counts, twice))  # remembered by the snapshot
    rollup.commit("c", token_rollup.signed(before=twice.where("source = 's1'")))
    assert all(r[0] != "s1" for r in rollup_rows(rollup)) and len(rollup_rows(rollup)) > 0
    rollup.compact()
    assert rollup.committed() == {"a", "b", "c"}
    assert token_rollup.contributions(empty(spark), "w", lambda: token_rollup.count_words).count() == 0


def test_rollup_folds_a_revision_of_chars_before_its_arrival(spark):
    rows = [("s1", "aa", "w", 1, 5, 10), ("s1", "aa", "w", 1, 5, 25)]
    first, revised = (spark.createDataFrame([r], "source string, lang string, version string, docs bigint, tokens bigint, chars bigint") for r in rows)
    rollup = token_rollup.TokenRollup(Store(spark, "test-fold"))
    rollup.commit("2-revised", token_rollup.signed(first, revised))
    rollup.compact()
    rollup.commit("1-arrivals", token_rollup.signed(after=first))
    assert [tuple(r) for r in rollup.totals().collect()] == rows[1:]


def test_bpe_counts_of_pieces_are_those_of_the_whole():
    text = ("The  quick brown\n\nfox's 12 jumps — " + "été " * 3) * 50
    with open(token_rollup.VOCABULARY, "rb") as file:
        ranks = file.read()
    encoding = token_rollup._encoding(ranks)
    whole = len(encoding.encode_ordinary(text))
    for size in (1, 7, 100):
        assert "".join(token_rollup.pieces(text, size)) == text
        assert sum(len(encoding.encode_ordinary(p)) for p in token_rollup.pieces(text, size)) == whole


def test_toxicity_chain(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic, low = rnd.random() < 0.3, rnd.random() < 0.3
        text = [rnd.choice(WORDS) for _ in range(30)] + (["scumbag", "foolish"] if toxic else []) + (["###"] * 3 if low else [])
        rnd.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels[:400], (1, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id bigint, low int, toxic int")
    sample = toxicity_chain.labelled_sample(docs, marks, ["low", "toxic"])
    assert sample.count() == 400
    chain = toxicity_chain.train_chain(sample, ["low", "toxic"], Store(spark, "test-chain"))
    got = {r.doc_id: r for r in toxicity_chain.predict_chain(docs, chain).collect()}
    right = [(got[i].p_toxic > 0.5) == bool(t) and (got[i].p_low > 0.5) == bool(q) for i, q, t in labels[400:]]
    assert np.mean(right) > 0.97
    assert toxicity_chain.predict_chain(awkward(spark), chain).count() == 14
    assert toxicity_chain.predict_chain(empty(spark), chain).count() == 0
    none = toxicity_chain.train_chain(
        toxicity_chain.labelled_sample(docs, empty(spark, "doc_id bigint, low int, toxic int"), ["low"]), ["low"], Store(spark, "test-none")
    )
    assert {r.p_low for r in toxicity_chain.predict_chain(docs, none).collect()} == {0.5}


def test_mixing_counts_are_poisson(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") < 15000, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("unused", 5.0)], "source string, weight double")
    out = poisson_mix.mix_sources(docs, weights, epochs=10.0)
    n = {r.s: r["count"] for r in out.groupBy(F.col("row.source").alias("s")).count().collect()}
    assert abs(n["a"] / 50000 - 1) < 0.03 and abs(n["b"] / 150000 - 1) < 0.03
    per = out.groupBy("row.doc_id", F.col("row.source").alias("s")).count().groupBy("s").agg(F.var_samp("count").alias("v")).collect()
    assert abs({r.s: r.v for r in per}["b"] / 30 - 1) < 0.1  # variance = mean, 30 copies in several draws
    again = poisson_mix.mix_sources(docs.repartition(7), weights, epochs=10.0)
    assert out.agg(F.sum(F.xxhash64("shuffle_key") % 1000003)).first() == again.agg(F.sum(F.xxhash64("shuffle_key") % 1000003)).first()


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    out = poisson_mix.mix_sources(docs, epochs=3.0)
    assert out.select("row.*").columns == docs.columns
    copies = {}
    for r in out.collect():
        copies.setdefault((r.row.doc_id, r.row.text), []).append(r.copy_no)
    assert {k[0] for k in copies} >= {3, None}  # null source and null id are drawn like others
    assert any(r.row.source is None for r in out.collect())
    # equal rows draw alike: the repeated document comes twice as often as each of its rows
    twice = sorted(copies[3, words(0, 39) + " other"])
    assert twice[::2] == twice[1::2] == list(range(1, len(twice) // 2 + 1))


def test_columns_with_clashing_or_odd_names(spark, languages):
    docs = spark.createDataFrame(
        [(1, "kato mira tomi rama", "aa", "s", 9, 5, "k", 1.5)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, Copy_No int, shuffle_key string, `my col` double",
    )
    mixed = poisson_mix.spread(poisson_mix.mix_sources(docs, epochs=9.0))
    assert mixed.columns == [*docs.columns, "copy_no_2", "shuffle_key_2"] and mixed.first()["my col"] == 1.5
    model = centroid_language.learn_languages(languages[1])
    assert centroid_language.identify(docs, model).select("row.*").first()["my col"] == 1.5
    items = spark.createDataFrame([(1, "something else entirely, not in any document")], "item_id bigint, text string")
    assert leak_match.without_leaks(docs, items).first()["my col"] == 1.5


def test_mixing_empty_tables(spark):
    docs = awkward(spark)
    assert poisson_mix.mix_sources(empty(spark)).count() == 0
    nothing = poisson_mix.mix_sources(docs, empty(spark, "source string, weight double"))
    assert nothing.count() == 0
