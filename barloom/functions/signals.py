"""Trading signals as CASE expressions: 1 long, -1 exit, 0 hold. An exit overrides a long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import col


def decide(long: Column, leave: Column) -> Column:
    return (
        F.when(F.coalesce(leave, F.lit(False)), F.lit(-1))
        .when(F.coalesce(long, F.lit(False)), F.lit(1))
        .otherwise(F.lit(0))
    )


def reference_prices(day_open="day_open", prev_close="prev_close", prev_dividend="prev_dividend"):
    """Higher and lower of today's open and the dividend-adjusted previous close."""
    adjusted = col(prev_close) - col(prev_dividend)
    return F.greatest(col(day_open), adjusted), F.least(col(day_open), adjusted)


def momentum(band_mult, ref_high="ref_high", ref_low="ref_low", sigma="sigma_open", vwap="vwap") -> Column:
    """Breakout of the day's reference range widened by the usual move at that minute."""
    close, m = F.col("close"), col(band_mult) if isinstance(band_mult, (str, Column)) else F.lit(float(band_mult))
    upper = col(ref_high) * (1 + m * col(sigma))
    lower = col(ref_low) * (1 - m * col(sigma))
    below = F.coalesce(close < lower, F.lit(False)) | F.coalesce(close < col(vwap), F.lit(False))
    return decide((close > upper) & (close > col(vwap)), below)


def band_breakout(upper="upper_band", lower="lower_band", vwap="vwap") -> Column:
    """Long above the upper band and VWAP; exit below the lower band or VWAP; needs both bands."""
    close, up, low = F.col("close"), col(upper), col(lower)
    valid = up.isNotNull() & low.isNotNull()
    below = F.coalesce(close < low, F.lit(False)) | F.coalesce(close < col(vwap), F.lit(False))
    return decide(valid & (close > up) & (close > col(vwap)), valid & below)


def mean_reversion(n_upper, n_lower, exit_threshold, z="zscore") -> Column:
    score, up, low, out = col(z), _num(n_upper), _num(n_lower), _num(exit_threshold)
    return decide(score < -low, (score > up) | ((score >= out) & (score <= up)))


def rsi_trend(oversold, overbought, exit_on_cross=True, rsi="rsi", sma="sma") -> Column:
    r, m, close = col(rsi), col(sma), F.col("close")
    leave = F.coalesce(r > _num(overbought), F.lit(False))
    if exit_on_cross:
        leave = leave | F.coalesce(close < m, F.lit(False))
    return decide((r < _num(oversold)) & (close > m), leave)


def rsi_dual_trend(oversold, overbought, require_alignment=True, rsi="rsi", short="sma_short", long="sma_long"):
    r, s, m, close = col(rsi), col(short), col(long), F.col("close")
    valid = r.isNotNull() & s.isNotNull() & m.isNotNull()
    enter = valid & (r < _num(oversold)) & (close > m)
    if require_alignment:
        enter = enter & (s > m)
    return decide(enter, valid & ((r > _num(overbought)) | (close < m)))


def rsi_contrarian(oversold, overbought, rsi="rsi") -> Column:
    return decide(col(rsi) < _num(oversold), col(rsi) > _num(overbought))


def pair(entry, exit_threshold, z="spread_z") -> Column:
    score, e, x = col(z), _num(entry), _num(exit_threshold)
    return decide(score < -e, (score > e) | ((score >= x) & (score <= e)))


def pair_symmetric(entry, exit_threshold, z="spread_z") -> Column:
    """Here -1 is a short position and 0 means flat inside the exit band."""
    score, e, x = col(z), _num(entry), F.abs(_num(exit_threshold))
    return (
        F.when((score >= -x) & (score <= x), F.lit(0))
        .when(score > e, F.lit(-1))
        .when(score < -e, F.lit(1))
        .otherwise(F.lit(0))
    )


def _num(v) -> Column:
    return col(v) if isinstance(v, (str, Column)) else F.lit(float(v))


_REGISTERED: dict[str, Callable[..., Column]] = {}


def register_signal(name: str, fn: Callable[..., Column]) -> None:
    """Add a user strategy: ``fn(**params)`` returns the signal as a Column over the bar columns."""
    if name in _REGISTERED:
        raise ValueError(f"signal {name!r} is already registered")
    _REGISTERED[name] = fn


def signal(name: str, **params) -> Column:
    try:
        return _REGISTERED[name](**params)
    except KeyError:
        raise ValueError(f"unknown signal {name!r}; known: {sorted(_REGISTERED)}") from None


for _name, _fn in {
    "momentum": momentum,
    "band_breakout": band_breakout,
    "mean_reversion": mean_reversion,
    "rsi_trend": rsi_trend,
    "rsi_dual_trend": rsi_dual_trend,
    "rsi_contrarian": rsi_contrarian,
    "pair": pair,
    "pair_symmetric": pair_symmetric,
}.items():
    register_signal(_name, _fn)
