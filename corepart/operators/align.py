"""Aligning part embeddings on the shared core by least squares.

`part_emb(part INT, id BIGINT, vec ARRAY<DOUBLE>)`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepart.operators.graph import restrict
from corepart.operators.sums import sum_in_two_steps


def core_by_count(part_emb: DataFrame, parts: int) -> DataFrame:
    """(id): ids that occur exactly once per part."""
    counts = part_emb.groupBy("id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.where(F.col("cnt") == parts).select("id")


def anchor_part(part_emb: DataFrame) -> DataFrame:
    """One row (part, n_rows): the part with most rows; ties go to the lowest part."""
    sizes = part_emb.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
    best = sizes.agg(F.max(F.struct("n_rows", (-F.col("part")).alias("neg"))).alias("b"))
    return best.where("b is not null").select((-F.col("b.neg")).alias("part"), F.col("b.n_rows").alias("n_rows"))


def core_embeddings(part_emb: DataFrame, parts: int) -> DataFrame:
    """The core's rows in every part."""
    return restrict(part_emb, core_by_count(part_emb, parts)).select("part", "id", "vec")


def core_pairs(core_emb: DataFrame, anchor: int) -> DataFrame:
    """(part, id, x, y): each part's core vector beside the anchor's."""
    y = core_emb.where(F.col("part") == anchor).select("id", F.col("vec").alias("y"))
    return core_emb.withColumnRenamed("vec", "x").join(y, "id").select("part", "id", "x", "y")


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype("float64")


def align_gram(pairs: DataFrame) -> DataFrame:
    """(part, n, gram, cross): sums of XᵀX and XᵀY per part, flattened row by row.

    Tasks add up their own rows first; one row per task and part is shuffled.
    """

    def partial(batches):
        sums: dict[int, list] = {}
        for pdf in batches:
            for part, rows in pdf.groupby("part"):
                x, y = _stack(rows["x"]), _stack(rows["y"])
                s = sums.setdefault(part, [0, 0.0, 0.0])
                s[0] += len(rows)
                s[1] = s[1] + x.T @ x
                s[2] = s[2] + x.T @ y
        for part, (n, gram, cross) in sums.items():
            yield pd.DataFrame({"part": [part], "s": [np.concatenate([gram.ravel(), cross.ravel(), [n]])]})

    rows = pairs.select("part", "x", "y").mapInPandas(partial, "part int, s array<double>")
    half = ((F.size("s") - 1) / 2).cast("int")
    return sum_in_two_steps(rows, "part", "s").select(
        "part",
        F.element_at("s", -1).cast("bigint").alias("n"),
        F.slice("s", F.lit(1), half).alias("gram"),
        F.slice("s", half + 1, half).alias("cross"),
    )


def fit_alignment(part_emb: DataFrame, parts: int, anchor: int, ridge: float = 0.0) -> dict[int, np.ndarray]:
    """Map per part: the d × d matrix W with X W ≈ Y over the core; no intercept.

    The driver holds two d × d sums per part, never the core itself.
    """
    sums = align_gram(core_pairs(core_embeddings(part_emb, parts), anchor)).collect()
    maps = {}
    for r in sums:
        d = int(round(len(r.gram) ** 0.5))
        gram = np.array(r.gram).reshape(d, d)
        if ridge:
            gram = gram + ridge * np.eye(d)
        elif r.n < d:
            raise ValueError(f"part {r.part}: {r.n} core rows for {d} dimensions; pass ridge > 0")
        if not np.linalg.cond(gram) < 1e14:
            raise ValueError(f"part {r.part}: the core vectors do not span {d} dimensions; pass ridge > 0")
        maps[r.part] = np.linalg.solve(gram, np.array(r.cross).reshape(d, d))
    return maps


def apply_maps(part_emb: DataFrame, maps: dict[int, np.ndarray]) -> DataFrame:
    """(part, id, vec): vec × W of its part; rows of a part without a map stay as they are."""

    def mapped(batches):
        for pdf in batches:
            out = pdf["vec"].copy()
            for part, rows in pdf.groupby("part"):
                if part in maps:
                    out.loc[rows.index] = list(_stack(rows["vec"]) @ maps[part])
            yield pdf.assign(vec=out)

    return part_emb.select("part", "id", "vec").mapInPandas(mapped, "part int, id bigint, vec array<double>")


def anchor_core_only(part_emb: DataFrame, core: DataFrame, anchor: int) -> DataFrame:
    """Drop the core's rows from every part but the anchor."""
    flagged = part_emb.join(core.select("id", F.lit(True).alias("in_core")), "id", "left")
    kept = (F.col("part") == anchor) | F.col("in_core").isNull()
    return flagged.where(kept).select("part", "id", "vec")


def align_residual(part_emb: DataFrame, parts: int, anchor: int, maps: dict[int, np.ndarray]) -> DataFrame:
    """(part, n, sse): squared distance of the mapped core from the anchor's core."""
    pairs = core_pairs(core_embeddings(part_emb, parts), anchor)
    moved = apply_maps(
        pairs.select("part", "id", F.col("x").alias("vec")), {p: w for p, w in maps.items() if p != anchor}
    )
    both = moved.join(pairs.select("part", "id", "y"), ["part", "id"])
    sse = F.aggregate(F.zip_with("vec", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(sse).alias("sse"))


def merge_embeddings(
    part_emb: DataFrame, parts: int, ridge: float = 0.0, dedupe: bool = False
) -> DataFrame:
    """(part, id, vec): all parts in the anchor's space.

    Anchor rows are unchanged; core rows come from the anchor only. A vertex that is in some
    parts but not in all is no anchor point and appears once per part, unless `dedupe` keeps
    the row of the lowest part.
    """
    top = anchor_part(part_emb).first()
    if top is None:
        return part_emb.select("part", "id", "vec")
    maps = fit_alignment(part_emb, parts, top.part, ridge)
    lost = [r.part for r in part_emb.select("part").distinct().collect() if r.part not in maps]
    if lost:
        raise ValueError(f"parts {sorted(lost)} have no core rows to align on")
    maps.pop(top.part)
    kept = anchor_core_only(part_emb, core_by_count(part_emb, parts), top.part)
    out = apply_maps(kept, maps)
    if dedupe:
        low = out.groupBy("id").agg(F.min_by("vec", "part").alias("vec"), F.min("part").alias("part"))
        out = low.select("part", "id", "vec")
    return out
