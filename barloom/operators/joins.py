"""Equi-, as-of and positional joins. As-of joins run on one row per day, then join back on the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.operators.series import BARS, DAY, Layout, numbered

TRADING_DAYS = 252


def join_dividends(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """Every bar of an ex-date carries its dividend, others 0; duplicate dividend rows fan out."""
    joined = bars.drop("dividend").join(dividends.select("symbol", "day", "dividend"), ["symbol", "day"], "left")
    return joined.withColumn("dividend", F.coalesce("dividend", F.lit(0.0)))


def join_by_day(bars: DataFrame, daily: DataFrame, *columns: str) -> DataFrame:
    return bars.join(daily.select("symbol", "day", *columns), ["symbol", "day"], "left")


def asof_risk_free(days: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``rf_daily``: the latest annual rate on or before the day over 252, else 0.

    A missing rate counts as a rate (it yields 0), so the carried value is a struct. Only the
    distinct days of both sides are ordered, which the calendar bounds.
    """
    axis = (
        days.select("day").distinct().select("day", F.lit(None).cast("struct<rate:double>").alias("_r"))
    ).unionByName(rates.select("day", F.struct(F.col("rate").cast("double").alias("rate")).alias("_r")))
    filled = (
        axis.groupBy("day")
        .agg(F.max_by("_r", F.col("_r").isNotNull().cast("int")).alias("_r"))
        .withColumn("_r", F.last("_r", ignorenulls=True).over(W.orderBy("day")))
    )
    daily = filled.select("day", (F.coalesce("_r.rate", F.lit(0.0)) / TRADING_DAYS).alias("rf_daily"))
    return days.join(daily, "day", "left")


def asof_benchmark_return(days: DataFrame, daily: DataFrame) -> DataFrame:
    """Add ``ret_ticker``: the daily close return of that day or of the latest earlier day."""
    w = W.partitionBy("symbol").orderBy("day")
    returns = daily.select(
        "symbol",
        "day",
        F.struct((F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1).alias("ret")).alias("_b"),
    )
    axis = days.select("symbol", "day").distinct().join(returns, ["symbol", "day"], "full")
    filled = axis.withColumn("_b", F.last("_b", ignorenulls=True).over(w))
    return days.join(
        filled.select("symbol", "day", F.col("_b.ret").alias("ret_ticker")), ["symbol", "day"], "left"
    )


def align_returns(returns: DataFrame, benchmark: DataFrame, keys=("symbol",)) -> DataFrame:
    """Days on which both the strategy and its benchmark have a return."""
    both = returns.select(*keys, "day", "ret").join(benchmark.select(*keys, "day", "ret_ticker"), [*keys, "day"])
    return both.where(F.col("ret").isNotNull() & F.col("ret_ticker").isNotNull())


def join_pair(bars: DataFrame, a: str, b: str, on: str = "position") -> DataFrame:
    """Two symbols side by side, aligned by bar number within the day or by timestamp."""
    layout = DAY
    if on == "position":
        num = numbered(bars.where(F.col("symbol").isin(a, b)), layout).drop("_n")
        keys = ["day", "_i"]
    else:
        num, keys = bars.where(F.col("symbol").isin(a, b)), ["day", "ts"]
    left = num.where(F.col("symbol") == a)
    right = num.where(F.col("symbol") == b).select(*keys, F.col("close").alias("close_b"))
    pair = left.join(right, keys).drop("_i")
    return pair.withColumn("symbol", F.lit(f"{a}/{b}")).withColumnRenamed("close", "close_a")


def join_prev_day(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Add the last close and the dividend of the previous trading day; the first day drops out."""
    w = W.partitionBy("symbol").orderBy("day")
    dividend = F.coalesce(F.col("dividend"), F.lit(0.0)) if "dividend" in daily.columns else F.lit(0.0)
    previous = daily.select(
        "symbol",
        "day",
        F.col("open").alias("day_open"),
        F.lag("close").over(w).alias("prev_close"),
        F.lag(dividend).over(w).alias("prev_dividend"),
        F.lag("day").over(w).alias("prev_day"),
    ).where(F.col("prev_day").isNotNull())
    return bars.join(previous, ["symbol", "day"])


def join_scores(bars: DataFrame, scores: DataFrame) -> DataFrame:
    return bars.join(scores.select("symbol", "ts", "probability"), ["symbol", "ts"], "left")


def rows_of_best(df: DataFrame, best: DataFrame, keys=("config_id", "symbol")) -> DataFrame:
    """Keep the rows of the winning configuration or version."""
    return df.join(best.select(*keys), list(keys), "left_semi")
