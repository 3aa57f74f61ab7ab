"""First-order recurrences y[t] = c * y[t-1] + b[t] with windows only.

Inside a sub-block of ``step`` rows the solution is a running sum of b * c**-k. What comes from
older sub-blocks has decayed below double precision except for the direct predecessor, whose last
local value is the only carry. Exponential averages, Wilder smoothing, RSI, ATR and MACD are all
instances. Coefficients that decay much faster than the slowest of a call get sub-blocks of their
own, so any of them can share a call.

A ratio of two such sums stays where it was while both only decay; callers whose result is a ratio
carry it over such rows themselves (see ``indicators.held_ratio``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from barloom.operators.series import Frame

_DIGITS = 18
_MAX_GROWTH = 280.0


def memory(c: float) -> int:
    """Rows after which a contribution has decayed below 1e-18."""
    return 1 if c <= 0 else max(1, math.ceil(_DIGITS * math.log(10) / -math.log(c)))


def common_step(*coefs: float) -> int:
    """Sub-block length of a call with several recurrences: that of the slowest."""
    return max(memory(c) for c in coefs)


def _sub_blocks(frame: Frame, c: float) -> tuple[int, Column, WindowSpec]:
    """Sub-block length, position in it and window up to the row for one coefficient. Powers over the length of the
    call must stay within double precision, else the coefficient's own memory is the length."""
    if frame.step * -math.log10(c) <= _MAX_GROWTH:
        return frame.step, frame.k, frame.sub
    own = memory(c)
    sub = W.partitionBy(*frame.part, F.floor(frame.i / own)).orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    return own, frame.i % own + 1, sub


def halo(step: int, levels: int = 1) -> int:
    """Earlier rows needed by ``levels`` recurrences that feed each other."""
    return 2 * step * levels


def ema_coef(span: int) -> float:
    return (span - 1.0) / (span + 1.0)


def wilder_coef(period: int) -> float:
    return (period - 1.0) / period


@dataclass(frozen=True)
class Recurrence:
    """``b`` names a column that holds the inputs, zero (not NULL) before the row ``start``."""

    out: str
    c: float
    b: str
    start: int = 0


def local_sums(frame: Frame, recs: list[Recurrence]) -> dict[str, Column]:
    """Stage one: the part of y that stems from the row's own sub-block."""
    out = {}
    for r in recs:
        if r.c <= 0:
            out[f"_loc_{r.out}"] = F.col(r.b)
            continue
        _, k, sub = _sub_blocks(frame, r.c)
        grown = F.col(r.b) * F.pow(F.lit(r.c), -k)
        out[f"_loc_{r.out}"] = F.pow(F.lit(r.c), k) * F.sum(grown).over(sub)
    return out


def carried(frame: Frame, recs: list[Recurrence]) -> dict[str, Column]:
    """Stage two: add what the previous sub-block hands over."""
    out = {}
    for r in recs:
        loc = F.col(f"_loc_{r.out}")
        if r.c <= 0:
            out[r.out] = F.when(frame.i >= r.start, loc)
            continue
        size, k, _ = _sub_blocks(frame, r.c)
        end = F.last(F.when(k == size, loc), ignorenulls=True).over(frame.rows.rowsBetween(W.unboundedPreceding, -1))
        out[r.out] = F.when(frame.i >= r.start, loc + F.pow(F.lit(r.c), k) * F.coalesce(end, F.lit(0.0)))
    return out


def stages(recs: list[Recurrence]) -> list:
    return [lambda f: local_sums(f, recs), lambda f: carried(f, recs)]


def ema_input(x: Column, span: int, frame: Frame) -> Column:
    """Inputs of an exponential average seeded with the first value."""
    c = ema_coef(span)
    return F.when(frame.i == 0, x).otherwise((1.0 - c) * x)


def seeded_input(x: Column, period: int, c: float, frame: Frame, first: int = 0) -> Column:
    """Inputs of an average seeded with the plain mean of ``period`` values from row ``first`` on."""
    start = first + period - 1
    seed = F.avg(x).over(frame.last(period))
    return (
        F.when(frame.i < start, F.lit(0.0)).when(frame.i == start, seed).otherwise((1.0 - c) * x)
    )
