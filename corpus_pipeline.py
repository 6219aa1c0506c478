"""A training-data pipeline over the table of documents: one operator per stage.

Every stage reads all rows that the stage before it kept and writes what it keeps; all but the
last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepart.llm.centroid_language import held_out, identify, learn_languages
from corepart.llm.exact_dedup import keep_one
from corepart.llm.jaccard_join import keep_one_of_each
from corepart.llm.leak_match import without_leaks
from corepart.llm.poisson_mix import mix_sources, spread
from corepart.llm.registry import table
from corepart.llm.saving import save_lean
from corepart.store import Store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no learned language accepts go: null, without a letter, or too far from all."""
    judged = identify(docs, learn_languages(docs.where(~held_out())))
    return judged.where(~F.col("rejected")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the greatest doc_id stays. Stages are given a scan of Parquet files.

    A null text equals an empty one; a null id is the least; of rows with one id and text one stays.
    """
    return keep_one(docs, from_files=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of 0.8 or more connect, the least doc_id stays.

    Texts without a word (null, empty, marks only) are linked to none but their equals.
    """
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edits, go.

    Null and empty documents and items match nothing; repeated rows are judged alike.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to weights that grow with the square root of a source's size.

    A null source is a source of its own; null and empty texts have no size, and sources of such
    texts alone go. Repeated rows are repeated alike, a null id draws by its text. Columns named
    like the added copy_no or shuffle_key stay, and the added one gets a number.
    """
    return spread(mix_sources(docs))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("mix", mix)]
# Centroids are learned and signatures hashed in tasks; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each writes its rows and the next reads them."""
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = save_lean(store, stage(spark, docs, sf_dir), f"stage-{at}")
        if at:
            store.drop(f"stage-{at - 1}")
    return docs
