"""Null-safe arithmetic helpers.

Spark 4 runs in ANSI mode: a division by zero or a bad cast raises. The
reference relied on pandas producing NaN/inf instead, so every ratio goes
through ``try_divide`` (NULL on a zero denominator) and NaN is mapped to NULL
at the edges (SQL NULL is the only missing value in this library).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den, add: float = 0.0) -> Column:
    """num / (den + add), NULL when the denominator is zero or NULL."""
    d = c(den) + F.lit(add) if add else c(den)
    return F.try_divide(c(num), d)


def nan_to_null(x) -> Column:
    """NaN and +-inf become NULL."""
    col = c(x)
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def clip_lower(x, lo: float = 0.0) -> Column:
    """max(x, lo) that keeps NULL (Spark ``greatest`` would skip the NULL)."""
    col = c(x)
    return F.when(col.isNull(), F.lit(None)).otherwise(F.greatest(col, F.lit(lo)))


def clip(x, lo=None, hi=None) -> Column:
    col = c(x)
    out = col
    if lo is not None:
        out = F.greatest(out, c(lo) if not isinstance(lo, (int, float)) else F.lit(lo))
    if hi is not None:
        out = F.least(out, c(hi) if not isinstance(hi, (int, float)) else F.lit(hi))
    return F.when(col.isNull(), F.lit(None)).otherwise(out)


def row_mean(cols, digits: int | None = None) -> Column:
    """Mean of the non-null values among ``cols`` (G18); NULL when all missing."""
    arr = F.filter(F.array(*[c(x).cast("double") for x in cols]), lambda v: v.isNotNull())
    s = F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    m = F.when(F.size(arr) > 0, s / F.size(arr))
    return F.round(m, digits) if digits is not None else m


def seq_asc(lo, hi) -> Column:
    """[lo, lo+1, ..., hi], empty when lo > hi (``sequence`` alone would count
    down)."""
    return F.when(c(lo) <= c(hi), F.sequence(c(lo), c(hi))).otherwise(F.array().cast("array<bigint>"))
