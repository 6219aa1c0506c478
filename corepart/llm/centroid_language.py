"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed letter pairs and triples, weighted by TF-IDF and normalised. The
inverse document frequencies count all training texts; the centroids are found by spherical
k-means on a bounded sample of each language. A text gets the language of the centroid with
the greatest cosine and is rejected when it is farther from it than training texts of its size
and language were: short texts are farther from everything, so the limit depends on the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corepart.llm.kept import kept
from corepart.llm.packed import packed, pieces
from corepart.llm.registry import query, table
from corepart.llm.saving import BATCH_ROWS, settings

PAIRS, TRIPLES = 1024, 4096
DIM = PAIRS + TRIPLES
SAMPLE = 1000  # training texts of each language that the centroids are fitted on
CENTROIDS = 4
ROUNDS = 12
SLACK = 1.05  # times the greatest training distance, for rejection
SIZES = (32, 128, 512, 2048)  # characters from which a limit holds; shorter texts are never too far
PIECE = 1 << 18  # characters handled at once
ROWS = 512  # texts in one matrix
ARROW_ROWS = 1000  # rows a task gets at once while the model is learned
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return kept("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def _low(hashed: np.ndarray, size: int) -> np.ndarray:
    """The hash modulo `size`, a power of two."""
    return (hashed & np.uint64(size - 1)).view(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, bool]:
    """Counts of hashed letter pairs and triples of the whole text, and whether it has a letter.

    Case is folded; each run of other characters, and each end of the text, is one blank.
    """
    counts, found = np.zeros(DIM, np.int64), False
    carry = np.array([32], np.uint32)  # the last two characters kept so far
    text, letters = text or "", _letters()
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters[codes]
        found |= bool(letter.any())
        codes = np.concatenate([carry, np.where(letter, codes, 32)])
        last = at + PIECE >= len(text)
        if last:
            codes = np.append(codes, np.uint32(32))
        blank = codes == 32
        blank[1:] &= blank[:-1]
        blank[0] = False
        new = len(carry)
        kept = np.flatnonzero(~blank)
        new = int(np.searchsorted(kept, new))  # grams that end before it were counted already
        codes = codes[kept].astype(np.uint64)
        if len(codes) > 1:
            pair = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            hashed = pair * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)
            counts[:PAIRS] += np.bincount(_low(hashed[max(new - 1, 0) :], PAIRS), minlength=PAIRS)
            if len(codes) > 2:
                triple = (pair[:-1] ^ pair[:-1] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + codes[2:]
                triple = triple * np.uint64(0x94D049BB133111EB) >> np.uint64(40)
                counts[PAIRS:] += np.bincount(_low(triple[max(new - 2, 0) :], TRIPLES), minlength=TRIPLES)
        carry = codes[-2:].astype(np.uint32)
    return counts, found


def size_class(counts: np.ndarray) -> int:
    """0 for the shortest texts, up to len(SIZES); a text has about as many pairs as characters."""
    return int(np.searchsorted(SIZES, counts[:PAIRS].sum(), "right"))


def log_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logarithms of each text's counts, its size class, and whether it has a letter.

    The counts of one text are held at a time.
    """
    rows = np.empty((len(texts), DIM), np.float32)
    sizes, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        counts, found[i] = gram_counts(text)
        sizes[i] = size_class(counts)
        rows[i] = np.log1p(counts)
    return rows, sizes, found


def unit_rows(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of `log_counts`, weighted and normalised in place."""
    rows *= idf
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    rows /= np.where(length > 0, length, 1)
    return rows


def limits(texts: list[str], idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The greatest distance of texts and of their parts, by size; no less than that of larger ones.

    A size that no text has gets the limit of the next smaller one: larger texts are nearer.
    """
    out, seen = np.zeros(len(SIZES) + 1), np.zeros(len(SIZES) + 1, bool)
    for size in (None, *SIZES):
        for lo in range(0, len(texts), ROWS):
            parts = [t if size is None else t[(len(t) - size) // 2 :][: size + size // 4] for t in texts[lo : lo + ROWS] if size is None or len(t) > size]
            rows, sizes, found = log_counts(parts)
            if found.any():
                far = 1 - (unit_rows(rows[found], idf) @ centres.T).max(1)
                np.maximum.at(out, sizes[found], far)
                seen[sizes[found]] = True
    out = np.minimum(np.maximum.accumulate(out[::-1])[::-1] * SLACK, 0.999)
    for size in range(1, len(out)):
        if not seen[size] and seen[:size].any():
            out[size] = out[size - 1]
    out[0] = 2.0
    return out


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each gram is, and the number of texts; a vector leaves each task as rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += gram_counts(text.as_py())[0] > 0
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, DIM), pa.int32()), pa.array(np.append(n, seen), pa.int64())], ["gram", "n"]
        )

    rows = texts.mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    by = {r.gram: r.n for r in rows}
    return np.array([by.get(g, 0) for g in range(DIM)], np.int64), by.get(-1, 0)


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means with farthest-first starts: unit centroids, no more than distinct rows."""
    starts = [0]
    near = rows @ rows[0]
    while len(starts) < min(k, len(rows)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-6:
            break
        starts.append(at)
        near = np.maximum(near, rows @ rows[at])
    centres = rows[starts]
    for _ in range(rounds):
        best = (rows @ centres.T).argmax(1)
        sums = np.stack([rows[best == c].sum(0) if (best == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-9)
    return centres


class LanguageModel:
    """Centroids with their languages, the limit of each for each size, and the IDF."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, radius: np.ndarray):
        self.idf, self.langs, self.centres, self.radius = idf, langs, centres, radius

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for lo in range(0, len(texts) if self.langs else 0, ROWS):
            rows, sizes, found = log_counts(texts[lo : lo + ROWS])
            cosine = unit_rows(rows, self.idf) @ self.centres.T
            best = cosine.argmax(1)
            for i in np.flatnonzero(found):
                b = best[i]
                langs[lo + i] = self.langs[b]
                scores[lo + i] = min(max(float(cosine[i, b]), 0.0), 1.0)
                rejected[lo + i] = 1 - cosine[i, b] > self.radius[b, sizes[i]]
        return langs, scores, rejected


def draw_sample(known: DataFrame, sample: int) -> DataFrame:
    """Rows (text, lang): min(sample, D) different texts of each language with D of them, by a hash of the text.

    The distinct hashes of a language are counted by their number of bits, so the bound below which
    enough of them lie is known. Rows beyond it stay where they are and copies are left out before
    the shuffle, so what a language sends to its task doesn't grow with the corpus.
    """
    h = F.xxhash64("text")
    marked = known.select("text", "lang", h.alias("h"), F.shiftrightunsigned(h, 1).alias("place"))
    marked = marked.withColumn("bits", F.length(F.bin("place")))
    counts: dict[str, dict[int, int]] = {}  # up to 63 rows per language
    for r in marked.select("lang", "h", "bits").distinct().groupBy("lang", "bits").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.lang, {})[r.bits] = r.n
    if not counts:
        return known
    bounds = {lang: next((b for b in sorted(n) if sum(n[c] for c in n if c <= b) >= sample), 63) for lang, n in counts.items()}
    bound = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))
    near = marked.where(F.col("bits") <= F.element_at(bound, F.col("lang"))).drop("bits")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # about 2 * sample for each language
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True))
            new = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
            yield batch.take(pa.array(new, pa.int32()))

    texts = near.mapInArrow(once, "text string, lang string, h bigint, place bigint").dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("place", "h")
    return texts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("text", "lang")


def learn_languages(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on rows (text, lang); rows without a language or without text are left out.

    At most `sample` different texts of each language, chosen by a hash of the text, are clustered;
    all texts count in the document frequencies. The driver holds one vector per centroid. No
    usable row gives a model that knows no language.
    """
    known = labelled.select("text", "lang").where(F.col("lang").isNotNull() & (F.col("text") != ""))
    with settings(labelled.sparkSession, {BATCH_ROWS: str(ARROW_ROWS)}):
        seen, n = document_frequencies(known.select("text"))
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    shared = labelled.sparkSession.sparkContext.broadcast(idf)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        rows, _, found = log_counts(list(group["text"]))
        if not found.any():
            return pd.DataFrame({"lang": [], "vec": [], "radius": []})
        rows = unit_rows(rows[found], shared.value)
        centres = cluster(rows, centroids)
        far = limits(list(group["text"]), shared.value, centres).tolist()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "vec": list(centres.astype(float)), "radius": [far] * len(centres)})

    drawn = draw_sample(known, sample)
    fitted = drawn.groupBy("lang").applyInPandas(fit, "lang string, vec array<double>, radius array<double>")
    with settings(labelled.sparkSession, {BATCH_ROWS: str(ARROW_ROWS)}):
        found = sorted(fitted.collect())
    return LanguageModel(
        idf,
        [r.lang for r in found],
        np.array([r.vec for r in found], np.float32).reshape(len(found), DIM),
        np.array([r.radius for r in found]).reshape(len(found), len(SIZES) + 1),
    )


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "language") -> DataFrame:
    """(all columns of docs packed in `row`, lang_pred, score, rejected).

    A null text and one without a letter are `und` with score 0 and are rejected. So is every
    text when no language was learned. Ties go to the first language in order of name.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.langs, model.centres, model.radius))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shared.value)
        for piece, texts in pieces(batches, at):
            langs, scores, rejected = model.judge(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
                ["row", "lang_pred", "score", "rejected"],
            )

    rows, at = packed(docs, "row", text)
    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(judge, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query("op7_centroid_language")
def op7_centroid_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = learn_languages(docs.where(~held_out()))
    judged = identify(docs.select("doc_id", "text"), model)
    return judged.select(F.col("row.doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "rejected")
