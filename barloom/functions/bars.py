"""Per-row expressions on bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import col, ratio

OPEN_MINUTE = 9 * 60 + 30
FULL_DAY = 390
SHORT_DAY = 210


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def minute_of_day(ts: Column | str = "ts") -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def bar_minute(ts: Column | str = "ts") -> Column:
    """1 for the bar that starts at the market open."""
    return minute_of_day(ts) - OPEN_MINUTE + 1


def price_position() -> dict[str, Column]:
    """Where the close lies within the range of its bar."""
    return {
        "price_position": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "dist_from_high": ratio(F.col("high") - F.col("close"), "high"),
        "dist_from_low": ratio(F.col("close") - F.col("low"), "close"),
    }


def time_features(ts: Column | str = "ts") -> dict[str, Column]:
    """Clock features; here the open is minute 0, unlike ``bar_minute``."""
    return _clock(minute_of_day(ts), F.hour(col(ts)), F.weekday(col(ts)))


def time_features_by_position(position: Column) -> dict[str, Column]:
    """Clock features for bars without a timestamp, from their 0-based position in the day."""
    minute = position + OPEN_MINUTE
    return _clock(minute, F.floor(minute / 60).cast("int"), F.lit(0))


def _clock(minute: Column, hour: Column, weekday: Column) -> dict[str, Column]:
    since_open = minute - OPEN_MINUTE
    return {
        "minute_of_day": minute.cast("int"),
        "min_from_open": since_open.cast("int"),
        "time_of_day_pct": since_open / float(FULL_DAY),
        "hour_of_day": hour.cast("int"),
        "day_of_week": weekday.cast("int"),
        "near_open": (since_open <= 30).cast("int"),
        "near_close": (since_open >= FULL_DAY - 30).cast("int"),
    }
