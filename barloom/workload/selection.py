"""Filters, slices and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import risk
from barloom.operators import selection as sel
from barloom.operators.features import features_for_scoring
from barloom.operators.joins import join_by_day
from barloom.operators.series import BARS, DAY, Scan, blocked_scan
from barloom.workload import fixtures as fx
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import BAR, out, r6


@query(
    "filter_date_range",
    sql(
        "ticks",
        """
        SELECT event_id, symbol, ts, close FROM ticks
        WHERE ts >= TIMESTAMP '2024-01-05'
          AND ts <= TIMESTAMP '2024-01-12' + INTERVAL 1 DAY - INTERVAL 1 SECOND""",
    ),
)
def filter_date_range(spark, sf):
    return sel.between_days(fx.ticks(spark, sf), "2024-01-05", "2024-01-12").select("event_id", "symbol", "ts", "close")


@query(
    "filter_market_hours",
    sql(
        "ticks",
        """
        SELECT event_id, symbol, ts FROM ticks
        WHERE CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '15:59:00'""",
    ),
)
def filter_market_hours(spark, sf):
    return sel.market_hours(fx.ticks(spark, sf)).select("event_id", "symbol", "ts")


@query(
    "last_n_days",
    sql(
        "ticks",
        """
        SELECT event_id, symbol, day FROM (
            SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM ticks)
        WHERE r <= 5""",
    ),
)
def last_n_days(spark, sf):
    return sel.last_days(fx.ticks(spark, sf), 5).select("event_id", "symbol", "day")


@query(
    "slice_rows",
    sql(
        "ticks",
        """
        SELECT event_id, symbol, ts FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
                   count(*) OVER (PARTITION BY symbol) AS n FROM ticks)
        WHERE i >= greatest(n - 120, 0) AND i < n - 20""",
    ),
)
def slice_rows(spark, sf):
    ticks, layout = fx.cut(fx.ticks(spark, sf))
    return sel.slice_rows(ticks, -120, -20, layout).select("event_id", "symbol", "ts")


@query(
    "warmup_drop",
    sql(
        "bars_1h",
        """
        SELECT symbol, ts, close FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i,
                   count(*) OVER (PARTITION BY symbol) AS n FROM bars_1h)
        WHERE i > 60 OR n <= 60""",
    ),
)
def warmup_drop(spark, sf):
    return sel.drop_warmup(fx.bars(spark, sf)).select("symbol", "ts", "close")


@query(
    "filter_trading_days",
    sql(
        "bars_1h",
        """
        SELECT symbol, ts, close FROM bars_1h
        WHERE isodow(day) < 6 AND day <> DATE '2024-01-15'""",
    ),
)
def filter_trading_days(spark, sf):
    return sel.trading_days(fx.bars(spark, sf), fx.holidays(spark, sf)).select("symbol", "ts", "close")


@query(
    "truncate_early_close",
    sql(
        "bars_1h",
        """
        SELECT symbol, ts, min_from_open FROM bars_1h
        WHERE day <> DATE '2024-01-10' OR min_from_open <= 13 * 60 - 570""",
    ),
)
def truncate_early_close(spark, sf):
    kept = sel.truncate_early_close(fx.bars(spark, sf), fx.early_closes(spark, sf))
    return kept.select("symbol", "ts", "min_from_open")


@query(
    "trading_minutes",
    sql(
        "ticks",
        """
        SELECT day, CASE WHEN isodow(day) >= 6 OR day = DATE '2024-01-15' THEN 0
                         WHEN day = DATE '2024-01-10' THEN 210 ELSE 390 END AS trading_minutes
        FROM (SELECT DISTINCT day FROM ticks)""",
    ),
)
def trading_minutes(spark, sf):
    return sel.trading_minutes(fx.days_of(spark, sf), fx.holidays(spark, sf), fx.early_closes(spark, sf))


@query(
    "select_features",
    sql(
        "bars_1h",
        """
        SELECT symbol, ts,
               round(coalesce(close / nullif(lag(close, 5) OVER w, 0) - 1,
                     first_value(close) OVER v / close * 0 +
                     nth_value(close, 6) OVER v / nullif(first_value(close) OVER v, 0) - 1), 6) AS momentum_5,
               hour(ts)::INTEGER AS hour_of_day
        FROM bars_1h
        WINDOW w AS (PARTITION BY symbol ORDER BY ts),
               v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    ),
)
def select_features(spark, sf):
    return out(features_for_scoring(fx.bars(spark, sf), ["momentum_5", "hour_of_day"]), BAR, "momentum_5", "hour_of_day")


_RISK = """
    SELECT t.event_id, t.symbol, t.close, d.open AS entry,
           max(t.close) OVER (PARTITION BY t.symbol, t.day ORDER BY t.ts) AS peak
    FROM ticks t JOIN daily d ON t.symbol = d.symbol AND t.day = d.day"""


def _entries(spark, sf):
    """Ticks against the day's open as entry and the day's high so far as peak."""
    ticks, layout = fx.cut(fx.ticks(spark, sf).drop("open"), DAY)
    day = fx.daily(spark, sf).select("symbol", "day", F.col("open").alias("entry"))
    return blocked_scan(ticks, [Scan("peak", "max", F.col("close"))], layout).join(day, ["symbol", "day"])


@query(
    "risk_predicates",
    sql(
        "daily",
        f"""
        SELECT event_id,
               CAST((close - entry) / entry <= -0.2 AS INTEGER) AS stop_hit,
               CAST((close - entry) / entry >= 0.5 AS INTEGER) AS target_hit,
               CAST(abs((close - peak) / peak) > 0.3 AS INTEGER) AS drawdown_hit,
               CASE WHEN (close - entry) / entry <= -0.2 THEN 2
                    WHEN (close - entry) / entry >= 0.5 THEN 3 ELSE 0 END AS reason
        FROM ({_RISK})""",
    ),
)
def risk_predicates(spark, sf):
    return _entries(spark, sf).select(
        "event_id",
        risk.stop_loss_hit("close", "entry", 0.2).cast("int").alias("stop_hit"),
        risk.take_profit_hit("close", "entry", 0.5).cast("int").alias("target_hit"),
        risk.drawdown_breached("close", "peak", 0.3).cast("int").alias("drawdown_hit"),
        risk.exit_reason("close", "entry", 0.2, 0.5).alias("reason"),
    )


@query(
    "position_pnl",
    sql(
        "daily",
        f"""
        SELECT event_id,
               round(CASE WHEN entry > 0 AND k > 0 THEN (close - entry) * k ELSE 0 END, 6) AS pnl,
               round(CASE WHEN entry > 0 AND k > 0 THEN (close - entry) / entry ELSE 0 END, 6) AS pnl_pct
        FROM (SELECT *, CAST(event_id % 5 AS DOUBLE) AS k FROM ({_RISK}))""",
    ),
)
def position_pnl(spark, sf):
    held = (F.col("event_id") % 5).cast("double")
    pnl, pct = risk.position_pnl("close", "entry", held)
    return out(_entries(spark, sf).select("event_id", pnl.alias("pnl"), pct.alias("pnl_pct")), ["event_id"], "pnl", "pnl_pct")
