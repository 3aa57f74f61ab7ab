"""Risk predicates and position arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import col

EXIT_SIGNAL, EXIT_STOP, EXIT_TARGET = 1, 2, 3


def pnl_pct(price: Column | str, entry: Column | str) -> Column:
    p, e = col(price), col(entry)
    return F.when(e > 0, (p - e) / F.nullif(e, F.lit(0.0)))


def stop_loss_hit(price, entry, limit) -> Column:
    return F.coalesce(pnl_pct(price, entry) <= -_lim(limit), F.lit(False))


def take_profit_hit(price, entry, limit) -> Column:
    return F.coalesce(pnl_pct(price, entry) >= _lim(limit), F.lit(False))


def drawdown(value: Column | str, peak: Column | str) -> Column:
    v, p = col(value), col(peak)
    return F.when(p > 0, (v - p) / F.nullif(p, F.lit(0.0))).otherwise(F.lit(0.0))


def drawdown_breached(value, peak, limit) -> Column:
    return F.coalesce(F.abs(drawdown(value, peak)) > _lim(limit), F.lit(False))


def exit_reason(price, entry, stop, target) -> Column:
    """2 for the stop, 3 for the target, 0 for neither; the stop is tested first."""
    return (
        F.when(stop_loss_hit(price, entry, stop), EXIT_STOP)
        .when(take_profit_hit(price, entry, target), EXIT_TARGET)
        .otherwise(0)
    )


def position_pnl(price, entry, shares) -> tuple[Column, Column]:
    """Absolute and relative profit; zero where nothing is held."""
    p, e, s = col(price), col(entry), col(shares)
    held = (e > 0) & (s > 0)
    return (
        F.when(held, (p - e) * s).otherwise(F.lit(0.0)),
        F.when(held, (p - e) / F.nullif(e, F.lit(0.0))).otherwise(F.lit(0.0)),
    )


def _lim(v) -> Column:
    return col(v) if isinstance(v, (str, Column)) else F.lit(float(v))
