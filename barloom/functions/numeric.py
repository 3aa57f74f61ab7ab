"""Null-safe arithmetic on Columns. NULL stands for "no value" everywhere; NaN is never produced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def finite(c: Column | str) -> Column:
    """NULL in place of NaN and the infinities."""
    x = col(c)
    bad = F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
    return F.when(~bad, x)


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def clip(c: Column | str, lo, hi) -> Column:
    """lo <= c <= hi; NULL stays NULL (greatest/least alone would skip it)."""
    x = col(c)
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.greatest(lo_c, F.least(hi_c, x)))


def trunc(c: Column | str) -> Column:
    """Integer part, towards zero."""
    return col(c).cast("bigint")


def bisect(bounds: Column | str, x: Column | str, most: int, strict: bool = False) -> Column:
    """How many of the sorted ``bounds``, at most ``most``, are at or below ``x`` (``strict``: below it), by halving steps.

    A lambda over the steps keeps the expression as small for thousands of bounds as for ten. NULL bounds count as none.
    """
    at, value = col(bounds), col(x)
    size = F.coalesce(F.size(at), F.lit(0))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))))

    def halve(found: Column, step: Column) -> Column:
        bound = F.get(at, found + step - 1)
        below = bound < value if strict else bound <= value
        return F.when((found + step <= size) & below, found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), halve)
