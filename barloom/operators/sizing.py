"""Position sizes from the history of daily returns. One row per (group, day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.numeric import clip, ratio, trunc
from barloom.operators.metrics import value_at_risk


def history(keys: Sequence[str], rows: int, skip: int = 0) -> WindowSpec:
    """The last ``rows`` days, ending ``skip`` days before the current one."""
    return W.partitionBy(*keys).orderBy("day").rowsBetween(-(rows - 1) - skip, -skip)


def _seen(ret: Column, keys: Sequence[str], skip: int) -> Column:
    return F.count(ret).over(W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -skip))


def rolling_vol(ret: Column, keys, days: int = 20, annualize: bool = False, population: bool = False) -> Column:
    w = history(keys, days)
    sd = (F.stddev_pop if population else F.stddev_samp)(ret).over(w)
    return F.when(F.count(ret).over(w) == days, sd * (252.0**0.5 if annualize else 1.0))


def trailing_sharpe(ret: Column, keys, days: int = 20, skip: int = 0) -> Column:
    """Mean over population deviation of the last days; 0 without variation, NULL when too short."""
    w = history(keys, days, skip)
    sd = F.stddev_pop(ret).over(w)
    value = F.when(sd > 0, ratio(F.avg(ret).over(w), sd)).otherwise(F.lit(0.0))
    return F.when(F.count(ret).over(w) == days, value)


def trailing_var(df: DataFrame, keys, days: int = 20, confidence: float = 0.95, out="daily_var") -> DataFrame:
    """VaR of up to ``days`` earlier returns; needs two of them."""
    w = history(keys, days, skip=1)
    with_list = df.withColumn("_r", F.sort_array(F.collect_list("ret").over(w)))
    n = F.size("_r")
    at = (F.lit(1.0 - confidence) * n).cast("int") + 1
    return with_list.withColumn(out, F.when(n >= 2, -F.try_element_at("_r", at))).drop("_r")


def sharpe_size(ret: Column, keys, base: float, days: int = 20, skip: int = 0) -> Column:
    scale = clip(1 + 0.2 * trailing_sharpe(ret, keys, days, skip), 0.5, 1.5)
    return F.coalesce(trunc(base * scale), F.lit(int(base)).cast("bigint"))


def kelly_raw(ret: Column, keys, days: int = 60, min_trades: int = 30, skip: int = 0) -> Column:
    """Win rate minus loss rate over the win/loss ratio; 0 while the history is too short."""
    w = history(keys, days, skip)
    win, loss = F.when(ret > 0, ret), F.when(ret < 0, -ret)
    n, wins, losses = F.count(ret).over(w), F.count(win).over(w), F.count(loss).over(w)
    p = ratio(wins.cast("double"), n.cast("double"))
    odds = ratio(F.avg(win).over(w), F.greatest(F.avg(loss).over(w), F.lit(1e-10)))
    return (
        F.when(_seen(ret, keys, skip) < min_trades, 0.0)
        .when(wins == 0, -1.0)
        .when(losses == 0, 1.0)
        .otherwise(p - ratio(1 - p, odds))
    )


def kelly_continuous_raw(ret: Column, keys, days: int = 60, min_periods: int = 30, skip: int = 0) -> Column:
    """Mean over population variance; without variation 1 for a positive mean, else 0."""
    w = history(keys, days, skip)
    mean, var = F.avg(ret).over(w), F.var_pop(ret).over(w)
    return (
        F.when(_seen(ret, keys, skip) < min_periods, 0.0)
        .when(var < 1e-16, F.when(mean > 0, 1.0).otherwise(0.0))
        .otherwise(ratio(mean, var))
    )


def kelly_size(raw: Column, enough: Column, base: float, fraction: float = 0.5, max_leverage: float = 1.0) -> Column:
    """Units to hold: the base size while the history is short, then the bounded Kelly fraction."""
    return F.when(~enough, F.lit(int(base)).cast("bigint")).otherwise(
        trunc(base * clip(raw * fraction, 0.0, max_leverage))
    )


def enough_history(ret: Column, keys, min_trades: int = 30, skip: int = 0) -> Column:
    return _seen(ret, keys, skip) >= min_trades


def size_factor(
    sizing: Column | str,
    vol: Column,
    target_vol: Column | float,
    raw_kelly: Column,
    enough: Column,
    fraction: Column | float = 0.5,
    max_leverage: float = 1.0,
    blend: float = 0.5,
) -> Column:
    """Share of capital to invest: volatility target, Kelly, or a blend of both."""
    kind = F.lit(sizing) if isinstance(sizing, str) else sizing
    target = target_vol if isinstance(target_vol, Column) else F.lit(float(target_vol))
    by_vol = F.when(vol > 0, F.least(ratio(target, vol), F.lit(max_leverage))).otherwise(F.lit(max_leverage))
    by_kelly = clip(raw_kelly * fraction, 0.0, max_leverage)
    return (
        F.when(kind == "kelly", F.when(enough, by_kelly).otherwise(F.lit(0.5 * max_leverage)))
        .when(kind == "kelly_vol_blend", F.when(enough, blend * by_kelly + (1 - blend) * by_vol).otherwise(by_vol))
        .otherwise(by_vol)
    )


def group_var(df: DataFrame, keys, confidence: float = 0.95) -> DataFrame:
    return df.groupBy(*keys).agg(value_at_risk(F.col("ret"), confidence).alias("var"))
