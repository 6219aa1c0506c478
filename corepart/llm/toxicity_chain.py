"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. The model of each sees the text's features and
the probabilities of the categories before it. For training, those probabilities come from
models that did not see the document (folds by a hash of the id); for prediction, from models
of all training rows. The models of one category are fitted at the same time, one task each,
on a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.registry import query, table
from corepart.llm.shingles import BASE, BYTE, SLICE, WORD, _powers, lowered, mix
from corepart.store import Store

FEATURES = 1 << 17
SAMPLE = 20_000  # labelled documents that the models are fitted on
FOLDS = 3
START = 5  # bytes of a word's beginning
ROUNDS, BATCH, RATE, PENALTY = 20, 256, 0.1, 1e-4
LEAST_Z = 5.0
TOXIC = 0.4
MARK = ~WORD
MARK[[9, 10, 13, 32, 44, 46]] = False  # white space, comma and full stop


def _run_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cut: int | None, salt: int):
    """(hash, place) of the longest runs of bytes that are `inside`; `cut` keeps their first bytes."""
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(mask & (~np.append(False, mask[:-1]) | edge[:-1]))
    stop = np.flatnonzero(mask & (~np.append(mask[1:], False) | edge[1:])) + 1
    if cut:
        stop = np.minimum(stop, begin + cut)
    power, inverse = _powers(1 << max(20, len(data).bit_length()))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(BYTE[data] * power[: len(data)], dtype=np.uint64))
    return mix((sums[stop] - sums[begin]) * inverse[begin] + np.uint64(salt)), begin


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, feature ids, offsets) for runs of texts.

    A text's features are its words, their beginnings and its runs of marks, each once, in lower
    case and hashed; and feature 0, which all texts have. Slices of a very long text are cut at
    the last byte that is in no word, where there is one.
    """
    data, offsets = lowered(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        kept = [np.arange(hi - lo, dtype=np.int64) * FEATURES]
        at, end = int(offsets[lo]), int(offsets[hi])
        while at < end:
            to = min(at + 4 * SLICE, end)
            if to < end and len(free := np.flatnonzero(~WORD[data[at:to]])):
                to = at + int(free[-1]) + 1
            inner = np.clip(offsets[lo : hi + 1], at, to) - at
            for inside, cut, salt in ((WORD, None, 1), (WORD, START, 2), (MARK, None, 3)):
                hashed, begin = _run_hashes(data[at:to], inner, inside, cut, salt)
                doc = np.searchsorted(offsets[lo : hi + 1], begin + at, "right") - 1
                kept.append(np.unique(doc * FEATURES + 1 + (hashed % np.uint64(FEATURES - 1)).astype(np.int64)))
            at = to
        ids = np.unique(np.concatenate(kept))
        doc = ids // FEATURES
        yield lo, hi, (ids % FEATURES).astype(np.int32), np.searchsorted(doc, np.arange(hi - lo + 1))
        lo = hi


@dataclass
class Linear:
    """Weights of the features and of the earlier categories' probabilities."""

    weights: np.ndarray
    chain: np.ndarray

    def probability(self, ids: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        score = np.add.reduceat(self.weights[ids].astype(np.float64), offsets[:-1]) + before @ self.chain
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def telling(rows: list[np.ndarray], target: np.ndarray, least: float = LEAST_Z) -> np.ndarray:
    """True for features whose shares of the two classes differ by `least` standard errors, and for feature 0.

    The others are mostly words of one or two documents, by which a model would know its training
    rows and nothing else.
    """
    counts = np.stack([
        np.bincount(np.concatenate([np.zeros(1, np.int32), *(r for r, t in zip(rows, target, strict=True) if t == c)]), minlength=FEATURES)
        for c in (0, 1)
    ]).astype(np.float64)
    n = np.maximum([(target == 0).sum(), (target == 1).sum()], 1)[:, None]
    share = counts.sum(0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    out = np.abs(counts[1] / n[1] - counts[0] / n[0]) > least * error
    out[0] = True
    return out


def fit_linear(rows: list[np.ndarray], before: np.ndarray, target: np.ndarray, seed: int = 0) -> Linear:
    """Logistic regression by AdaGrad over shuffled batches, on the features that tell the classes apart."""
    use = telling(rows, target)
    rows = [ids[use[ids]] for ids in rows]
    model = Linear(np.zeros(FEATURES, np.float32), np.zeros(before.shape[1]))
    squares, chain_squares = np.full(FEATURES, 1e-8, np.float32), np.full(before.shape[1], 1e-8)
    draw = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        order = draw.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            pick = order[lo : lo + BATCH]
            ids = np.concatenate([rows[i] for i in pick])
            count = np.array([len(rows[i]) for i in pick])
            error = model.probability(ids, np.append(0, np.cumsum(count)), before[pick]) - target[pick]
            slope = np.bincount(ids, np.repeat(error / len(pick), count), FEATURES).astype(np.float32)
            slope += PENALTY * model.weights
            squares += slope * slope
            model.weights -= RATE * slope / np.sqrt(squares)
            if before.shape[1]:
                slope = error @ before[pick] / len(pick)
                chain_squares += slope * slope
                model.chain -= RATE * slope / np.sqrt(chain_squares)
    return model


@dataclass
class Chain:
    """Of each category, in order: the model of all rows, and those of the folds."""

    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    fold_models: list[list[Linear]] = field(default_factory=list)

    def predict(self, ids: np.ndarray, offsets: np.ndarray, fold: int | None = None) -> np.ndarray:
        """Probabilities, a column per category fitted so far; of a fold by models that left it out."""
        out = np.zeros((len(offsets) - 1, len(self.models)))
        for at, model in enumerate(self.models):
            used = model if fold is None else self.fold_models[at][fold]
            out[:, at] = used.probability(ids, offsets, out[:, :at])
        return out

    def plain(self) -> tuple:
        """Lists and arrays only: what workers can read that don't have this class."""
        return self.categories, [(m.weights, m.chain) for m in self.models], [[(m.weights, m.chain) for m in f] for f in self.fold_models]

    @staticmethod
    def of(plain: tuple) -> Chain:
        categories, models, folds = plain
        return Chain(categories, [Linear(*m) for m in models], [[Linear(*m) for m in f] for f in folds])


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, one column of 0 or 1 per category): at most `sample` labelled documents.

    Labels with a null are left out; of several labels of an id the greatest counts. The ids are
    chosen by hash, so the rows broadcast to the documents are bounded by `sample`. A repeated
    document counts once, with one of its texts.
    """
    usable = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *categories]))
    unique = usable.groupBy("doc_id").agg(*(F.max(F.col(c).cast("double")).alias(c) for c in categories))
    ids = unique.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])


def train_chain(sample: DataFrame, categories: list[str], store: Store, folds: int = FOLDS) -> Chain:
    """Fit the chain on `labelled_sample` rows. Without rows every probability is 0.5."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, offsets in features(batch.column("text")):
                part = batch.slice(lo, hi - lo).drop_columns(["text"])
                yield part.append_column("ids", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)))

    targets = "".join(f", `{c}` double" for c in categories)
    rows = sample.mapInArrow(featured, f"doc_id bigint{targets}, ids array<int>")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)).cast("int")
    rows = store.save(rows.withColumn("fold", fold), "sample")
    chain = Chain(categories)
    # Model k leaves fold k out; model `folds` sees all.
    models = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda k: k != F.col("fold"))
    for category in categories:
        dealt = rows.select("doc_id", category, "ids", "fold", F.explode(models).alias("model"))
        fit = _fitting(category, sample.sparkSession.sparkContext.broadcast(chain.plain()))
        found = dealt.groupBy("model").applyInPandas(fit, "model int, weights binary, chain binary").collect()
        fitted = {r.model: Linear(np.frombuffer(r.weights, np.float32), np.frombuffer(r.chain, np.float64)) for r in found}
        none = Linear(np.zeros(FEATURES, np.float32), np.zeros(len(chain.models)))
        chain.models.append(fitted.get(folds, none))
        chain.fold_models.append([fitted.get(k, none) for k in range(folds)])
    return chain


def _fitting(category: str, known: Broadcast):
    """The fit of one model on its rows; `known` is the chain up to this category."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group, chain = group.sort_values("doc_id", kind="stable"), Chain.of(known.value)
        ids = list(group["ids"])
        before = np.zeros((len(ids), len(chain.models)))
        for k in group["fold"].unique():  # out-of-fold probabilities of the categories before
            at = np.flatnonzero(group["fold"] == k)
            offsets = np.append(0, np.cumsum([len(ids[i]) for i in at]))
            before[at] = chain.predict(np.concatenate([ids[i] for i in at]), offsets, int(k))
        model = fit_linear(ids, before, group[category].to_numpy())
        return pd.DataFrame(
            {"model": group["model"].iloc[:1], "weights": [model.weights.tobytes()], "chain": [model.chain.tobytes()]}
        )

    return fit


def predict_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, one probability p_<category> per category) of every row of `docs`.

    A null text and an empty one have feature 0 only. Repeated rows are repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Chain(chain.categories, chain.models).plain())
    names = [f"p_{c}" for c in chain.categories]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain.of(shared.value)
        for batch in batches:
            for lo, hi, ids, offsets in features(batch.column("text")):
                found = chain.predict(ids, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(c) for c in found.T)], ["doc_id", *names]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id bigint" + "".join(f", `{n}` double" for n in names))


@query("op4_toxicity_chain")
def op4_toxicity_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Low quality, then toxicity, of every document; a toxic one has a probability of TOXIC or more."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").withColumn("low_quality", 1 - F.col("quality"))
    categories = ["low_quality", "toxic"]
    chain = train_chain(labelled_sample(docs, labels, categories), categories, Store(spark, "toxicity"))
    return predict_chain(docs, chain).withColumn("toxic", F.col("p_toxic") >= TOXIC)
