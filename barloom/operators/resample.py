"""Bars from ticks and coarser bars from finer ones. All aggregates combine map-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.bars import bar_minute

Aggregates = Mapping[str, Column]


def first_by(value: str, order: str) -> Column:
    """Earliest non-null value."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def last_by(value: str, order: str) -> Column:
    """Latest non-null value."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def ohlcv(order: str) -> dict[str, Column]:
    return {
        "open": first_by("open", order),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": last_by("close", order),
        "volume": F.sum("volume"),
    }


def resample_intraday(
    df: DataFrame, minutes: int, extra: Aggregates | None = None, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """k-minute bars, labelled and closed on the left; buckets without a close are dropped.

    ``extra`` adds or replaces aggregates. Without it ``vwap`` keeps its last value and
    ``dividend`` is summed where those columns exist.
    """
    aggs = ohlcv("ts")
    if "vwap" in df.columns:
        aggs["vwap"] = last_by("vwap", "ts")
    if "dividend" in df.columns:
        aggs["dividend"] = F.sum("dividend")
    aggs.update(extra or {})
    bars = df.groupBy(*keys, F.window("ts", f"{minutes} minutes").alias("_w")).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )
    return (
        bars.where(F.col("close").isNotNull())
        .select(*keys, F.col("_w.start").alias("ts"), *aggs)
        .withColumns({"day": F.to_date("ts"), "min_from_open": bar_minute("ts")})
    )


def resample_training(df: DataFrame, minutes: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """As above for model input: VWAP averaged, rows with any missing value dropped."""
    extra = {"vwap": F.avg("vwap")} if "vwap" in df.columns else {}
    bars = resample_intraday(df, minutes, extra, keys)
    return bars.dropna(subset=[c for c in bars.columns if c not in keys])


def resample_daily(df: DataFrame, period: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily bars to weeks (labelled by their Sunday) or months (labelled by their last day)."""
    labels = {
        "week": F.date_add(F.date_trunc("week", "day").cast("date"), 6),
        "month": F.last_day("day"),
    }
    if period not in labels:
        raise ValueError("period must be 'week' or 'month'")
    full = df.dropna(subset=["open", "high", "low", "close", "volume"])
    return full.groupBy(*keys, labels[period].alias("period")).agg(
        *[c.alias(n) for n, c in ohlcv("day").items()]
    )


def daily_from_intraday(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return df.groupBy(*keys, "day").agg(
        *[c.alias(n) for n, c in ohlcv("ts").items()], F.count(F.lit(1)).alias("n_bars")
    )
