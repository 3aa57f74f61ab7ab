"""Filters, slices and predicates over bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.bars import FULL_DAY, OPEN_MINUTE, SHORT_DAY
from barloom.operators.series import BARS, Layout, numbered


def between_days(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """From ``start`` to the last full second of ``end``; both reach the scan as range predicates."""
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        last = F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")
        df = df.where(F.col("ts") <= last)
    return df


def market_hours(df: DataFrame, start: str = "09:30", end: str = "15:59") -> DataFrame:
    """Keep bars whose time of day lies in [start, end], to the microsecond."""
    seconds = lambda hhmm: int(hhmm[:2]) * 3600 + int(hhmm[3:]) * 60
    # EXTRACT(SECOND) has the fraction; no time zone is involved
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), "ts")
    return df.where((clock >= seconds(start)) & (clock <= seconds(end)))


def last_days(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows of the latest n distinct days per series; ranks days, not rows."""
    newest = W.partitionBy(*keys).orderBy(F.desc("day"))
    days = df.select(*keys, "day").distinct()
    recent = days.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")
    return df.join(recent, [*keys, "day"], "left_semi")


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, layout: Layout = BARS) -> DataFrame:
    """Rows [start, end) of each series; negative bounds count from its end."""
    lo = F.lit(start) if start >= 0 else F.greatest(F.col("_n") + start, F.lit(0))
    hi = F.col("_n") if end is None else F.lit(end) if end >= 0 else F.col("_n") + end
    return numbered(df, layout).where((F.col("_i") >= lo) & (F.col("_i") < hi)).drop("_i", "_n")


def drop_warmup(df: DataFrame, rows: int = 60, layout: Layout = BARS) -> DataFrame:
    """Drop the first ``rows`` rows of every series that is longer than that."""
    return (
        numbered(df, layout).where((F.col("_i") >= rows) | (F.col("_n") <= rows)).drop("_i", "_n")
    )


def is_weekend(day: Column | str = "day") -> Column:
    return F.weekday(day) >= 5


def trading_days(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Drop weekends and the dates in ``holidays(day)``."""
    return df.where(~is_weekend()).join(holidays.select("day"), "day", "left_anti")


def truncate_early_close(df: DataFrame, early_closes: DataFrame) -> DataFrame:
    """On the days in ``early_closes(day, close_min)`` drop bars after the close."""
    closes = early_closes.select("day", (F.col("close_min") - OPEN_MINUTE).alias("_last"))
    keep = F.coalesce(F.col("min_from_open") <= F.col("_last"), F.lit(True))
    return df.join(closes, "day", "left").where(keep).drop("_last")


def in_session(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars of the days that ``sessions(day, closed, last_minute)`` does not close, up to the last minute of short days.

    Days that the table does not name are whole sessions. It has one row a day, so it stays small.
    """
    rules = sessions.select("day", "closed", "last_minute")
    open_ = ~F.coalesce("closed", F.lit(False)) & F.coalesce(F.col("min_from_open") <= F.col("last_minute"), F.lit(True))
    return df.join(rules, "day", "left").where(open_).drop("closed", "last_minute")


def trading_minutes(days: DataFrame, holidays: DataFrame, early_closes: DataFrame) -> DataFrame:
    """Length of the session of each day: 0, 210 or 390 minutes."""
    closed = holidays.select("day", F.lit(True).alias("_closed"))
    early = early_closes.select("day", F.lit(True).alias("_early"))
    minutes = (
        F.when(is_weekend() | F.col("_closed").isNotNull(), 0)
        .when(F.col("_early").isNotNull(), SHORT_DAY)
        .otherwise(FULL_DAY)
    )
    return (
        days.join(closed, "day", "left")
        .join(early, "day", "left")
        .withColumn("trading_minutes", minutes)
        .drop("_closed", "_early")
    )


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not available: {missing}")
    return df.select(*[k for k in keep if k in df.columns and k not in features], *features)
