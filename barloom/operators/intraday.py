"""Intraday columns derived while ingesting bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.bars import bar_minute, minute_of_day, typical_price
from barloom.functions.numeric import ratio
from barloom.operators.joins import join_by_day
from barloom.operators.series import DAY, Layout, Scan, blocked_scan, numbered



def vwap(df: DataFrame, layout: Layout = DAY) -> DataFrame:
    """Volume-weighted typical price of the day so far; NULL while nothing has traded."""
    scans = [Scan("_traded", "sum", F.col("volume") * typical_price()), Scan("_volume", "sum", F.col("volume"))]
    return blocked_scan(df, scans, layout).withColumn("vwap", ratio("_traded", "_volume")).drop("_traded", "_volume")


def move_open(df: DataFrame, layout: Layout = DAY) -> DataFrame:
    """Absolute move of the close from the day's first open; 0 where that open is 0."""
    start = F.col("_start.open")
    move = F.when(start == 0, F.lit(0.0)).otherwise(F.abs(ratio("close", start) - 1))
    return blocked_scan(df, [Scan("_start", "head", F.struct("open"))], layout).withColumn("move_open", move).drop("_start")


def daily_vol(daily: DataFrame, days: int = 15, lag: int = 0) -> DataFrame:
    """Sample deviation of the last ``days`` daily close returns, all required.

    The window includes the day's own close, as users of intraday bars are used to; ``lag=1``
    shifts it to the day before and so removes the look-ahead.
    """
    w = W.partitionBy("symbol").orderBy("day")
    r = daily.withColumn("_r", ratio("close", F.lag("close").over(w)) - 1)
    frame = w.rowsBetween(-(days - 1) - lag, -lag)
    vol = F.when(F.count("_r").over(frame) == days, F.stddev_samp("_r").over(frame))
    return r.withColumn("ticker_dvol", vol).drop("_r")


def join_daily_vol(bars: DataFrame, daily: DataFrame, days: int = 15, lag: int = 0) -> DataFrame:
    return join_by_day(bars, daily_vol(daily, days, lag), "ticker_dvol")


def minute_index(df: DataFrame) -> DataFrame:
    return df.withColumns({"min_from_open": bar_minute(), "minute_of_day": minute_of_day()})


def minute_index_by_position(df: DataFrame, layout: Layout = DAY) -> DataFrame:
    """For bars whose time of day is unknown: the bar's number within its day."""
    return numbered(df, layout).withColumn("min_from_open", (F.col("_i") + 1).cast("int")).drop("_i", "_n")


def sigma_open(df: DataFrame, days: int = 14) -> DataFrame:
    """Usual move from the open at this minute: mean and deviation over the previous days.

    Partitions are (symbol, minute of day), so each holds one row per day.
    """
    w = W.partitionBy("symbol", "minute_of_day").orderBy("ts").rowsBetween(-days, -1)
    enough = F.count("move_open").over(w) >= days - 1
    return df.withColumns(
        {
            "move_open_rolling_mean": F.when(enough, F.avg("move_open").over(w)),
            "sigma_open": F.when(enough, F.stddev_samp("move_open").over(w)),
        }
    )


def derived_columns(bars: DataFrame, daily: DataFrame, vol_days: int = 15, sigma_days: int = 14) -> DataFrame:
    """VWAP, move from open, daily volatility, minute index and the opening-move statistics."""
    ready = minute_index(move_open(vwap(bars)))
    return sigma_open(join_daily_vol(ready, daily, vol_days), sigma_days)


def ohlc_fallback(df: DataFrame, layout: Layout = DAY) -> DataFrame:
    """Open, high and low for data that only has closes and the day's open."""
    scans = [
        Scan("_start", "head", F.struct("day_open")),
        Scan("high", "max", F.col("close")),
        Scan("low", "min", F.col("close")),
    ]
    return blocked_scan(df.drop("high", "low"), scans, layout).withColumn("open", F.col("_start.day_open")).drop("_start")
