"""Series derived from the driver tables, in Spark and as the CTEs the SQL checks start from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.joins import join_pair
from barloom.operators.resample import daily_from_intraday, resample_intraday
from barloom.operators.series import BARS, ROWS_PER_BLOCK, Layout, cut_blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Ticks of one task; days with more are cut.
TICK_BLOCK = ROWS_PER_BLOCK


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` the check covers rows and schema only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str, calm: bool = False) -> DataFrame:
    """Events as ticks. Raw values move by multiples a day; ``calm`` scales them to a share price
    around 100 that moves by percents, for results that compound."""
    price = 100 + F.col("value") / 100 if calm else F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        "ts",
        F.to_date("ts").alias("day"),
        price.alias("open"),
        price.alias("high"),
        price.alias("low"),
        price.alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def cut(ticks: DataFrame, layout: Layout = BARS) -> tuple[DataFrame, Layout]:
    """Ticks with days that are longer than a task cut into blocks."""
    return cut_blocks(ticks, layout, TICK_BLOCK)


def bars(spark: SparkSession, sf: str, minutes: int = 60, calm: bool = False) -> DataFrame:
    return resample_intraday(ticks(spark, sf, calm), minutes)


def daily(spark: SparkSession, sf: str, calm: bool = False) -> DataFrame:
    return daily_from_intraday(ticks(spark, sf, calm))


def daily_long(spark: SparkSession, sf: str) -> DataFrame:
    """A price series over years: orders by priority; the day's bar from order keys."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def pair(spark: SparkSession, sf: str, minutes: int = 60) -> DataFrame:
    return join_pair(bars(spark, sf, minutes), "click", "view")


def scored_ticks(spark: SparkSession, sf: str, calm: bool = False) -> DataFrame:
    p = ((F.col("event_id") * 7919) % 1000) / F.lit(1000.0)
    return ticks(spark, sf, calm).withColumn("probability", p)


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    """0.10 on every day of month ending in 5, the first one twice for one symbol."""
    days = ticks(spark, sf).select("symbol", "day").distinct().where(F.dayofmonth("day") % 10 == 5)
    rows = days.withColumn("dividend", F.lit(0.10))
    again = rows.where((F.col("symbol") == "click") & (F.dayofmonth("day") == 5))
    return rows.unionByName(again)


def risk_free(spark: SparkSession, sf: str) -> DataFrame:
    """Every third day of the events, starting on the fourth; the rate of one day is missing."""
    days = ticks(spark, sf).select("day").distinct()
    n = F.dayofmonth("day")
    return days.where((n % 3 == 1) & (n > 1)).select(
        "day", F.when(n != 13, 0.05 + 0.001 * n).alias("rate")
    )


def days_of(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).select("day").distinct()


def holidays(spark: SparkSession, sf: str) -> DataFrame:
    return days_of(spark, sf).where(F.col("day") == F.lit("2024-01-15").cast("date"))


def early_closes(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lit("2024-01-10").cast("date")
    return days_of(spark, sf).where(F.col("day") == day).withColumn("close_min", F.lit(13 * 60))


# ------------------------------------------------------------------ the same in SQL


def _bars_sql(minutes: int) -> str:
    return f"""
    SELECT symbol, ts, CAST(ts AS DATE) AS day, open, high, low, close, volume,
           CAST(hour(ts) * 60 + minute(ts) - 569 AS INTEGER) AS min_from_open
    FROM (SELECT symbol, time_bucket(INTERVAL {minutes} MINUTE, ts) AS ts,
                 arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
                 arg_max(close, ts) AS close, sum(volume) AS volume
          FROM ticks GROUP BY 1, 2)"""


CTES: dict[str, tuple[list[str], str]] = {
    "ticks": (
        [],
        """
    SELECT event_id, event_type AS symbol, ts, CAST(ts AS DATE) AS day, value AS open, value AS high,
           value AS low, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume
    FROM events""",
    ),
    "bars_1h": (["ticks"], _bars_sql(60)),
    "bars_5m": (["ticks"], _bars_sql(5)),
    "daily": (
        ["ticks"],
        """
    SELECT symbol, day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_bars
    FROM ticks GROUP BY 1, 2""",
    ),
    "daily_long": (
        [],
        """
    SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day,
           arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
           min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
           CAST(count(*) AS DOUBLE) AS volume
    FROM orders GROUP BY 1, 2""",
    ),
    "daily_ret": (
        ["daily"],
        """
    SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS ret
    FROM daily""",
    ),
    "long_ret": (
        ["daily_long"],
        """
    SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS ret
    FROM daily_long""",
    ),
    "pair_1h": (
        ["bars_1h"],
        """
    SELECT 'click/view' AS symbol, a.ts, a.day, a.min_from_open, a.close AS close_a, b.close AS close_b
    FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts) AS n FROM bars_1h WHERE symbol = 'click') a
    JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts) AS n FROM bars_1h WHERE symbol = 'view') b
      ON a.day = b.day AND a.n = b.n""",
    ),
    "scored": (["ticks"], "SELECT *, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS probability FROM ticks"),
    "dividends": (
        ["ticks"],
        """
    SELECT d.symbol, d.day, 0.10::DOUBLE AS dividend
    FROM (SELECT DISTINCT symbol, day FROM ticks WHERE day(day) % 10 = 5) d,
         (VALUES (1), (2)) v(n)
    WHERE n = 1 OR (d.symbol = 'click' AND day(d.day) = 5)""",
    ),
    "risk_free": (
        ["ticks"],
        """
    SELECT day, CASE WHEN day(day) <> 13 THEN 0.05::DOUBLE + 0.001::DOUBLE * day(day) END AS rate
    FROM (SELECT DISTINCT day FROM ticks) WHERE day(day) % 3 = 1 AND day(day) > 1""",
    ),
    "rf_daily": (
        ["ticks", "risk_free"],
        """
    SELECT d.day, coalesce(r.rate, 0) / 252 AS rf_daily
    FROM (SELECT DISTINCT day FROM ticks) d ASOF LEFT JOIN risk_free r ON d.day >= r.day""",
    ),
}


_RAW_TICKS = CTES["ticks"][1]
_CALM_TICKS = re.sub(r"\bvalue AS", "100 + value / 100 AS", _RAW_TICKS)


def sql(uses: str, body: str, recursive: bool = False, calm: bool = False) -> str:
    """``body`` under the CTEs named in ``uses`` and everything they need."""
    done: list[str] = []

    def need(name: str) -> None:
        if name not in done:
            for dep in CTES[name][0]:
                need(dep)
            done.append(name)

    for name in uses.split():
        need(name)
    text = {n: CTES[n][1] for n in done} | ({"ticks": _CALM_TICKS} if calm else {})
    parts = [f"{n} AS MATERIALIZED ({text[n]})" for n in done]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
