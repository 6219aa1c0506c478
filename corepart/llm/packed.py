"""Whole rows that pass through Python tasks, with one of their columns as the text to judge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_ROWS = 512  # rows judged and sent back at once


def packed(docs: DataFrame, name: str, text: str = "text") -> tuple[DataFrame, int | None]:
    """(all columns of docs in the struct `name`), and the place of the text in it.

    A text that isn't named exactly like one column (a nested field, say) is a second column, and
    the place is None; else it would travel twice.
    """
    alike = [i for i, c in enumerate(docs.columns) if c.lower() == text.lower()]
    if len(alike) == 1 and docs.columns[alike[0]] == text:
        return docs.select(F.struct("*").alias(name)), alike[0]
    return docs.select(F.struct("*").alias(name), F.col(text).alias("text")), None


def pieces(batches: Iterator[pa.RecordBatch], at: int | None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches of PIECE_ROWS rows at most and their texts: what a task makes of a batch stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PIECE_ROWS):
            piece = batch.slice(lo, PIECE_ROWS)
            yield piece, piece.column(1) if at is None else piece.column(0).field(at)
