"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A change of the corpus is a table of contributions with a sign: what was there counts -1, what
is there now +1, so inserts, deletes and revised counts are sums of the same kind. A batch of
deltas is summed and committed once under its name; committing it again changes nothing.
Totals are sums over the committed batches, in any order.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.kept import kept
from corepart.llm.registry import query, table
from corepart.store import Store

KEYS = ["source", "lang", "version"]
SUMS = ["docs", "tokens", "chars"]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 20  # characters tokenized at once
_CUT = re.compile(r"(?<=\S) (?=\S)")  # the pattern never matches across the place before such a blank


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters whose tokens are those of the whole."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _encoding(ranks: bytes) -> tiktoken.Encoding:
    def make() -> tiktoken.Encoding:
        by_token = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=by_token, special_tokens={})

    return kept(("encoding", ranks), make)


def count_words(text: str) -> int:
    return len(text.split())


def bpe_counter(ranks: bytes) -> Callable[[str], int]:
    encoding = _encoding(ranks)
    return lambda text: sum(len(encoding.encode_ordinary(piece)) for piece in pieces(text))


def contributions(docs: DataFrame, version: str, counter: Callable[[], Callable[[str], int]]) -> DataFrame:
    """(doc_id, source, lang, version, docs, tokens, chars, digest): one row per document.

    `counter` is called once per task and gives the function that counts a text's tokens. A null
    text has none.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint"), "source", "lang", F.coalesce("text", F.lit("")).alias("text")
    ).select("*", F.length("text").cast("bigint").alias("chars"), F.unhex(F.sha2("text", 256)).alias("digest"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter()
        for batch in batches:
            counts = pa.array([tokens(t.as_py()) for t in batch.column("text")], pa.int64())
            yield batch.drop_columns(["text"]).append_column("tokens", counts)

    counted = rows.mapInArrow(count, "doc_id bigint, source string, lang string, chars bigint, digest binary, tokens bigint")
    return counted.withColumns({"version": F.lit(version), "docs": F.lit(1).cast("bigint")})


def signed(before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Delta rows: `before` taken away, `after` added. One alone is a delete or an insert."""

    def times(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*KEYS, *((F.col(c) * sign).cast("bigint").alias(c) for c in SUMS))

    if before is None or after is None:
        return times(after, 1) if before is None else times(before, -1)
    return times(before, -1).unionByName(times(after, 1))


class TokenRollup:
    """Committed batches of deltas in a folder of the shared store.

    `commit` writes a batch's sums under its name; the batch counts once its table is complete,
    so a commit that dies leaves nothing behind and is simply made again. One writer at a time.
    """

    def __init__(self, store: Store):
        self.store = store

    def _names(self) -> list[str]:
        folder = self.store._hadoop("batches")
        fs, path, _ = folder
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in names if self.store.complete(f"batches/{n}"))

    def committed(self) -> set[str]:
        """All batches that count: on their own or within a snapshot."""
        names = self._names()
        folded = set()
        for n in names:
            if n.startswith("snapshot-"):
                folded |= {r.batch for r in self.store.read(f"folded/{n}").collect()}
        return folded | {n for n in names if not n.startswith("snapshot-")}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False, and no change, when it was committed before."""
        if batch.startswith("snapshot-") or "/" in batch:
            raise ValueError(f"not a name for a batch: {batch}")
        if batch in self.committed():
            return False
        self.store.save(deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)), f"batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens, chars); groups whose sums are all 0 are left out."""
        schema = "source string, lang string, version string, docs bigint, tokens bigint, chars bigint"
        names = self._live()
        if not names:
            return self.store.spark.createDataFrame([], schema)
        rows = self.store.spark.read.schema(schema).parquet(*(self.store.path(f"batches/{n}") for n in names))
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def _live(self) -> list[str]:
        """The latest snapshot, and the batches that it does not hold."""
        names = self._names()
        snapshots = [n for n in names if n.startswith("snapshot-")]
        if not snapshots:
            return names
        folded = {r.batch for r in self.store.read(f"folded/{snapshots[-1]}").collect()}
        return [snapshots[-1], *(n for n in names if n not in folded and n not in snapshots)]

    def compact(self) -> None:
        """Fold all batches into one snapshot, which remembers their names; then drop them."""
        names, batches = self._names(), sorted(self.committed())
        snapshots = [n for n in names if n.startswith("snapshot-")]
        name = f"snapshot-{len(batches):012d}"
        if name in snapshots:
            return
        self.store.save(self.store.spark.createDataFrame([(b,) for b in batches], "batch string"), f"folded/{name}")
        self.store.save(self.totals(), f"batches/{name}")
        for n in names:
            self.store.drop(f"batches/{n}")


@query("op3_token_rollup")
def op3_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals with provisional word counts, revised counts, a second tokenizer, repeats deleted.

    What is returned are totals after exact dedup: of equal texts the greatest doc_id counts.
    A batch that is sent again changes nothing.
    """
    store = Store(spark, "token-rollup")
    docs = table(spark, sf, "documents")
    with open(VOCABULARY, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())  # one fixed file of 0.8 MB
    words = store.save(contributions(docs, "words-1", lambda: count_words), "words")
    bpe = store.save(contributions(docs, "byte-bpe-50k-1", lambda: bpe_counter(ranks.value)), "bpe")
    provisional = docs.select(
        "source", "lang", F.lit("words-1").alias("version"), F.lit(1).alias("docs"),
        F.floor(F.coalesce("n_chars", F.lit(0)) / 6).alias("tokens"), F.coalesce("n_chars", F.lit(0)).alias("chars"),
    )
    both = words.unionByName(bpe)
    stays = words.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = both.join(stays, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep")))

    rollup = TokenRollup(store)
    rollup.commit("1-arrivals", signed(after=provisional))
    rollup.commit("2-revised", signed(provisional, words))
    rollup.commit("3-bpe", signed(after=bpe))
    rollup.compact()
    rollup.commit("4-repeats", signed(before=repeats))
    rollup.commit("2-revised", signed(provisional, words))
    rollup.commit("4-repeats", signed(before=repeats))
    return rollup.totals()
