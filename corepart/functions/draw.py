"""Random choices as pure functions of their keys.

A generator inside a task would draw again when a lost executor's work is
recomputed, so the same vertex could land in two parts. A keyed draw gives the
same number on every attempt, and plain SQL can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits: exact in a double, and fine enough to reach every row
# of a table with more than 2^32 rows.
HEX_DIGITS = 13
DRAW_RANGE = float(16**HEX_DIGITS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw(*keys, salt: str) -> Column:
    """Uniform number in [0, 1) that depends only on the keys and the salt."""
    text = F.concat_ws(":", *[_col(k).cast("string") for k in keys], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint") / F.lit(DRAW_RANGE)


def draw_int(*keys, salt: str, k: int, start: int = 0) -> Column:
    """Uniform integer in start .. start + k - 1."""
    return (F.floor(draw(*keys, salt=salt) * k) + start).cast("int")


def fast_normal(*keys, salt: str, dim: int, scale: float = 1.0) -> Column:
    """Array of `dim` normal numbers from a 64-bit hash (start values of a model)."""

    def uniform(i: Column, which: int) -> Column:
        h = F.xxhash64(*[_col(k) for k in keys], i, F.lit(which), F.lit(salt))
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))

    def normal(i: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(uniform(i, 0)))
        return radius * F.cos(F.lit(2 * math.pi) * uniform(i, 1)) * F.lit(scale)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal)
