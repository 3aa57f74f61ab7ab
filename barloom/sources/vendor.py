"""Vendor JSON pages to bars and dividends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.selection import market_hours

BAR_PAGE = "results ARRAY<STRUCT<t: BIGINT, v: DOUBLE, o: DOUBLE, h: DOUBLE, l: DOUBLE, c: DOUBLE>>, next_url STRING"
DIVIDEND_PAGE = "results ARRAY<STRUCT<ex_dividend_date: STRING, cash_amount: DOUBLE>>"
ZONE = "America/New_York"


def bars_from_pages(pages: DataFrame, page: str = "page", regular_hours: bool = True) -> DataFrame:
    """One row per bar, epoch milliseconds turned into exchange-local time."""
    rows = pages.select("symbol", F.explode(F.from_json(page, BAR_PAGE).getField("results")).alias("r"))
    micros = (F.col("r.t") * 1000).cast("bigint")
    utc = F.timestamp_micros(micros)
    # Written out in New York and read back without a zone, whatever the zone of the session.
    local = F.convert_timezone(F.current_timezone(), F.lit(ZONE), utc.cast("timestamp_ntz"))
    bars = rows.select(
        "symbol",
        local.alias("ts"),
        F.col("r.o").alias("open"),
        F.col("r.h").alias("high"),
        F.col("r.l").alias("low"),
        F.col("r.c").alias("close"),
        F.col("r.v").alias("volume"),
    )
    return market_hours(bars) if regular_hours else bars


def dividends_from_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    rows = pages.select("symbol", F.explode(F.from_json(page, DIVIDEND_PAGE).getField("results")).alias("r"))
    return rows.select(
        "symbol", F.to_date("r.ex_dividend_date").alias("day"), F.col("r.cash_amount").alias("dividend")
    )
