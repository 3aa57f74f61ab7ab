"""Positions, exits, ledger, risk; and the flagship scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions import signals as sig
from barloom.operators import indicators as ind
from barloom.operators import joins, sizing
from barloom.operators import metrics as m
from barloom.operators import positions as pos
from barloom.session import materialize
from barloom.workload import fixtures as fx
from barloom.workload.aggregates import daily_returns, long_returns
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import BAR, DAY, out
from barloom.workload.signals import decide
from barloom.workload.windows import WD, WS, _DAYW, pair_ctes, z_lagged

STOP, TARGET = 0.3, 0.8
COST = 0.0001


def reversion_bars(spark, sf):
    bars = ind.zscore_lagged(fx.bars(spark, sf), [20]).withColumnRenamed("z_20", "zscore")
    signal = sig.signal("mean_reversion", n_upper=2.0, n_lower=0.8, exit_threshold=0.4)
    return bars.withColumn("signal", signal)


def latched(spark, sf):
    """Positions; each running step re-reads its input, so the signals are written once."""
    return pos.latch_position(pos.every_kth(materialize(reversion_bars(spark, sf)), 2))


def latch_ctes(src: str, k: int | str = 2, part: str = "symbol", skip_first_day: bool = True) -> str:
    """Position of every bar of ``src(part, day, ts, signal)``, decided at every k-th bar of a day.

    Written over decision bars only: a position is the latest order of an earlier decision bar,
    where the last decision bar of a day gives no order.
    """
    return f"""
    l0 AS (SELECT *, row_number() OVER (PARTITION BY {part}, day ORDER BY ts) - 1 AS bar,
                  min(day) OVER (PARTITION BY {part}) AS day0 FROM {src}),
    l1 AS (SELECT *, bar // {k} AS slot, max(bar // {k}) OVER (PARTITION BY {part}, day) AS last_slot FROM l0),
    l2 AS (SELECT {part}, day, slot, ts AS slot_ts,
                  CASE WHEN signal <> 0 AND slot < last_slot AND day {">" if skip_first_day else ">="} day0 THEN (signal = 1)::INTEGER END AS told
           FROM l1 WHERE bar % {k} = 0),
    l3 AS (SELECT *, coalesce(last_value(told IGNORE NULLS) OVER (
               PARTITION BY {part} ORDER BY slot_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM l2),
    po AS (SELECT l1.*, l3.position FROM l1 JOIN l3 USING ({part}, day, slot))"""


_REV = f"""
    rv AS (SELECT *, {decide('z < -0.8', 'z > 2 OR (z >= 0.4 AND z <= 2)')}
           FROM (SELECT *, {z_lagged(20)} AS z FROM bars_1h))"""


def run_ctes(part: str = "symbol", mark: str = "close") -> str:
    w = f"PARTITION BY {part} ORDER BY ts"
    return f"""
    r0 AS (SELECT *, position = 1 AND coalesce(lag(position) OVER ({w}), 0) = 0 AS enters FROM po),
    r1 AS (SELECT *, sum(enters::INTEGER) OVER ({w} ROWS UNBOUNDED PRECEDING) AS nth FROM r0),
    rn AS (SELECT *, CASE WHEN position = 1 THEN nth END AS run_id,
               CASE WHEN position = 1 THEN first_value({mark}) OVER (PARTITION BY {part}, nth ORDER BY ts) END AS entry_price,
               CASE WHEN position = 1 THEN first_value(ts) OVER (PARTITION BY {part}, nth ORDER BY ts) END AS entry_ts FROM r1)"""


def barrier_ctes(stop: str, target: str, part: str = "symbol", pnl: str = "(close - entry_price) / entry_price") -> str:
    """The first bar of every run beyond a barrier ends it."""
    w = f"PARTITION BY {part} ORDER BY ts"
    return f"""
    b0 AS (SELECT *, CASE WHEN run_id IS NULL THEN 0 WHEN {pnl} <= -{stop} THEN 2 WHEN {pnl} >= {target} THEN 3 ELSE 0 END AS hit FROM rn),
    b1 AS (SELECT *, min(CASE WHEN hit > 0 THEN ts END) OVER (PARTITION BY {part}, run_id) AS cut_ts FROM b0),
    b2 AS (SELECT *, CASE WHEN run_id IS NOT NULL AND (cut_ts IS NULL OR ts < cut_ts) THEN 1 ELSE 0 END AS held FROM b1),
    b3 AS (SELECT *, coalesce(lag(held) OVER ({w}), 0) AS was FROM b2),
    be AS (SELECT *, CASE WHEN was = 1 AND held = 0 THEN CASE WHEN run_id IS NOT NULL THEN hit ELSE 1 END ELSE 0 END AS exit_reason FROM b3)"""


@query("latch_position", sql("bars_1h", f"WITH {_REV}, {latch_ctes('rv')} SELECT symbol, ts, signal, position FROM po"))
def latch_position(spark, sf):
    return latched(spark, sf).select(*BAR, "signal", "position")


@query(
    "runs",
    sql(
        "bars_1h",
        f"""WITH {_REV}, {latch_ctes('rv')}, {run_ctes()}
        SELECT symbol, ts, CAST(run_id AS BIGINT) AS run_id, entry_price, entry_ts FROM rn""",
    ),
)
def runs(spark, sf):
    return pos.runs(latched(spark, sf)).select(*BAR, "run_id", "entry_price", "entry_ts")


def stopped(spark, sf):
    return materialize(pos.barrier_exit(pos.runs(latched(spark, sf)), STOP, TARGET))


_STOPPED = f"{_REV}, {latch_ctes('rv')}, {run_ctes()}, {barrier_ctes(f'{STOP}::DOUBLE', f'{TARGET}::DOUBLE')}"


@query(
    "barrier_exit",
    sql("bars_1h", f"WITH {_STOPPED} SELECT symbol, ts, held AS position, exit_reason FROM be"),
)
def barrier_exit(spark, sf):
    return stopped(spark, sf).select(*BAR, "position", "exit_reason")


@query(
    "barrier_exit_spread",
    sql(
        "pair_1h",
        f"""WITH {pair_ctes(30)}, ps AS (SELECT symbol, day, ts, close_a, spread, spread AS close,
               {decide('spread_z < -0.5', 'spread_z > 2 OR (spread_z >= 0.5 AND spread_z <= 2)')} FROM sz),
        {latch_ctes('ps', 1)}, {run_ctes()},
        {barrier_ctes('0.5::DOUBLE', '1.5::DOUBLE', pnl='(spread - entry_price) / nullif(abs(entry_price), 0)')}
        SELECT symbol, ts, held AS position, exit_reason FROM be""",
    ),
)
def barrier_exit_spread(spark, sf):
    pair = ind.pair_spread(fx.pair(spark, sf), 30)
    signal = sig.signal("pair", entry=2.0, exit_threshold=0.5)
    # Entry below -0.5, exit as for the symmetric threshold of 2.
    signal = F.when(signal == -1, -1).when(F.col("spread_z") < -0.5, 1).otherwise(0)
    bars = pos.every_kth(materialize(pair.withColumns({"signal": signal, "close": F.col("spread")})), 1)
    held = pos.runs(pos.latch_position(bars)).withColumnRenamed("entry_price", "entry_spread")
    cut = pos.barrier_exit(held, 0.5, 1.5, pnl=pos.spread_pnl())
    return cut.select(*BAR, "position", "exit_reason")


SLIP, COMM = "0.00001::DOUBLE", "0.0035::DOUBLE"
LEDGER_CTES = f"""
    t0 AS (SELECT *, CASE WHEN held = 1 AND was = 0 THEN 'BUY' WHEN held = 0 AND was = 1 THEN 'SELL' END AS side FROM be),
    t1 AS (SELECT *, CASE WHEN side = 'BUY' THEN least(
               CAST(trunc(100000 * 0.99::DOUBLE / (close * (1 + {SLIP}) + {COMM})) AS BIGINT),
               CAST(trunc(100000 * 0.5::DOUBLE / (close * (1 + {SLIP}))) AS BIGINT)) END AS want FROM t0 WHERE side IS NOT NULL),
    t2 AS (SELECT *, last_value(want IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS shares FROM t1),
    tl AS (SELECT *, shares * close * {SLIP} AS slippage, shares * {COMM} AS commission,
               CASE WHEN side = 'BUY' THEN -(shares * close + shares * close * {SLIP} + shares * {COMM})
                    ELSE shares * close - shares * close * {SLIP} - shares * {COMM} END AS cash_flow FROM t2 WHERE shares > 0)"""


def ledger(spark, sf):
    return pos.trade_ledger(stopped(spark, sf), size=0.5)


@query(
    "trade_ledger",
    sql(
        "bars_1h",
        f"""WITH {_STOPPED}, {LEDGER_CTES} SELECT symbol, ts, side, shares, round(slippage, 8) + 0 AS slippage,
        round(commission, 6) + 0 AS commission, round(cash_flow, 7) + 0 AS cash_flow, exit_reason FROM tl""",
    ),
)
def trade_ledger(spark, sf):
    rows = out(ledger(spark, sf), BAR, "side", "shares", "slippage", "commission", "exit_reason", "cash_flow", digits=8)
    return rows.withColumns({"commission": F.round("commission", 6), "cash_flow": F.round("cash_flow", 7)})


MARK_CTES = """
    k0 AS (SELECT be.symbol, be.day, be.ts, be.close, be.held, coalesce(tl.cash_flow, 0) AS flow,
               coalesce(CASE WHEN tl.side = 'BUY' THEN tl.shares WHEN tl.side = 'SELL' THEN -tl.shares END, 0) AS delta
           FROM be LEFT JOIN tl ON be.symbol = tl.symbol AND be.ts = tl.ts),
    k1 AS (SELECT *, 100000 + sum(flow) OVER w AS cash, CAST(sum(delta) OVER w AS BIGINT) AS shares
           FROM k0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    mk AS (SELECT *, cash + shares * close AS value FROM k1),
    md AS (SELECT symbol, day, arg_max(value, ts) AS value, arg_max(shares, ts) AS shares, arg_max(close, ts) AS close,
                  arg_max(held, ts) AS position FROM mk GROUP BY 1, 2),
    mr AS (SELECT *, value / nullif(lag(value) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS ret FROM md)"""


def marked(spark, sf):
    held = stopped(spark, sf)
    return pos.mark_to_market(held, pos.trade_ledger(held, size=0.5))


@query(
    "mark_to_market",
    sql(
        "bars_1h",
        f"""WITH {_STOPPED}, {LEDGER_CTES}, {MARK_CTES}
        SELECT symbol, ts, round(cash, 7) + 0 AS cash, shares, round(value, 7) + 0 AS value FROM mk""",
    ),
)
def mark_to_market(spark, sf):
    return out(marked(spark, sf), BAR, "cash", "shares", "value", digits=7)


def marked_days(spark, sf):
    days = marked(spark, sf).groupBy("symbol", "day").agg(
        F.max_by("value", "ts").alias("value"),
        F.max_by("shares", "ts").alias("shares"),
        F.max_by("close", "ts").alias("close"),
        F.max_by("position", "ts").alias("position"),
    )
    w = W.partitionBy("symbol").orderBy("day")
    return days.withColumn("ret", F.col("value") / F.nullif(F.lag("value").over(w), F.lit(0.0)) - 1)


@query(
    "ledger_returns",
    sql(
        "bars_1h",
        f"WITH {_STOPPED}, {LEDGER_CTES}, {MARK_CTES} SELECT symbol, day, shares, round(ret, 6) + 0 AS ret FROM mr",
    ),
)
def ledger_returns(spark, sf):
    return out(pos.ledger_returns(marked(spark, sf)), DAY, "shares", "ret")


SR_CTES = f"""
    c0 AS (SELECT *, coalesce(lag(position) OVER w, 0) AS was0,
               coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS chg FROM po WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    sr AS (SELECT symbol, day, product(1 + was0 * 0.01::DOUBLE * chg - {COST}::DOUBLE * abs(position - was0)) - 1 AS ret
           FROM c0 GROUP BY 1, 2)"""


def strategy_days(spark, sf):
    return pos.strategy_returns(latched(spark, sf), COST, 0.01)


@query(
    "strategy_returns",
    sql("bars_1h", f"WITH {_REV}, {latch_ctes('rv')}, {SR_CTES} SELECT symbol, day, round(ret, 6) + 0 AS ret FROM sr"),
)
def strategy_returns(spark, sf):
    return out(strategy_days(spark, sf), DAY, "ret")


@query(
    "reversion_scorecard",
    sql(
        "bars_1h",
        f"""WITH {_REV}, {latch_ctes('rv')}, {SR_CTES},
        q AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS eq FROM sr),
        d AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS pk FROM q)
        SELECT symbol, round(CASE WHEN count(ret) >= 20 THEN CASE WHEN stddev_samp(ret) > 0
                   THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END END, 6) + 0 AS sharpe_ratio,
               round(min((eq - pk) / pk), 6) + 0 AS max_drawdown, round(product(1 + ret) - 1, 6) + 0 AS total_return
        FROM d GROUP BY symbol""",
    ),
)
def reversion_scorecard(spark, sf):
    """Which series has the best z-score reversion Sharpe ratio?"""
    days = m.with_drawdown(m.with_equity(strategy_days(spark, sf), ["symbol"]), ["symbol"])
    r = F.col("ret")
    card = days.groupBy("symbol").agg(
        m.sharpe(r).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        m.total_return(r).alias("total_return"),
    )
    return out(card, ["symbol"], "sharpe_ratio", "max_drawdown", "total_return")


@query(
    "drawdown_breaker",
    sql(
        "long_ret",
        """
        WITH a AS (SELECT symbol, day, ret * 0.05 AS ret FROM long_ret),
        e AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS eq FROM a),
        p AS (SELECT *, coalesce(lag(eq) OVER (PARTITION BY symbol ORDER BY day), 1) AS prior FROM e),
        k AS (SELECT *, greatest(max(prior) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 1) AS peak FROM p),
        b AS (SELECT *, min(CASE WHEN abs((prior - peak) / peak) > 0.15 THEN day END) OVER (PARTITION BY symbol) AS stop_day FROM k)
        SELECT symbol, day, CAST(coalesce(day >= stop_day, FALSE) AS INTEGER) AS halted,
               round(CASE WHEN day > stop_day THEN 0 ELSE ret END, 6) + 0 AS ret FROM b""",
    ),
)
def drawdown_breaker(spark, sf):
    days = long_returns(spark, sf).withColumn("ret", F.col("ret") * 0.05)
    return out(pos.drawdown_breaker(days, 0.15), DAY, "halted", "ret")


_VOL5 = f"""CASE WHEN count(dret) OVER v = 5 THEN least(0.3::DOUBLE / nullif(stddev_samp(dret) OVER v, 0), 1) ELSE 1 END"""


@query(
    "vol_rebalance_flag",
    sql(
        "bars_1h daily_ret",
        f"""WITH {_STOPPED}, {LEDGER_CTES}, {MARK_CTES},
        f0 AS (SELECT md.*, d.ret AS dret FROM md JOIN daily_ret d USING (symbol, day)),
        f1 AS (SELECT *, {_VOL5} AS size_factor FROM f0 WINDOW v AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
        f2 AS (SELECT *, CAST(trunc(value * size_factor / nullif(close, 0)) AS BIGINT) AS target_shares,
                   lag(CASE WHEN position = 1 THEN size_factor ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day) AS prior FROM f1)
        SELECT symbol, day, target_shares, CAST(coalesce(position = 1 AND shares > 0
               AND abs(size_factor - prior) / nullif(prior, 0) >= 0.25
               AND abs(target_shares - shares) / nullif(shares, 0)::DOUBLE >= 0.1, FALSE) AS INTEGER) AS rebalance FROM f2""",
    ),
)
def vol_rebalance_flag(spark, sf):
    vols = daily_returns(spark, sf).withColumn("vol", sizing.rolling_vol(F.col("ret"), ("symbol",), 5))
    days = marked_days(spark, sf).join(vols.select("symbol", "day", "vol"), ["symbol", "day"])
    size = F.when(F.col("vol") > 0, F.least(0.3 / F.nullif("vol", F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return pos.vol_rebalance_flag(days.withColumn("size_factor", size)).select(*DAY, "target_shares", "rebalance")


STATS_SQL = """
    ts AS (SELECT symbol, count(*) AS total_trades, count(*) FILTER (WHERE side = 'BUY') AS buy_trades,
               count(*) FILTER (WHERE side = 'SELL') AS sell_trades,
               count(*) FILTER (WHERE side = 'SELL' AND exit_reason = 2) AS stop_losses,
               count(*) FILTER (WHERE side = 'SELL' AND exit_reason = 3) AS take_profits FROM tl GROUP BY symbol)"""


@query(
    "trade_stats",
    sql("bars_1h", f"WITH {_STOPPED}, {LEDGER_CTES}, {STATS_SQL} SELECT * FROM ts"),
)
def trade_stats(spark, sf):
    return pos.trade_stats(ledger(spark, sf))


@query(
    "risk_summary",
    sql(
        "bars_1h",
        f"""WITH {_STOPPED}, {LEDGER_CTES}, {MARK_CTES}, {STATS_SQL},
        u AS (SELECT *, max(value) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS pk FROM md),
        g AS (SELECT symbol, max(value) AS peak, arg_max(value, day) AS last_value,
                  arg_max((value - pk) / pk, day) AS current_drawdown,
                  count(*) FILTER (WHERE abs((value - pk) / pk) > 0.2) AS breaches FROM u GROUP BY 1)
        SELECT symbol, round(peak, 7) + 0 AS peak, round(last_value, 7) + 0 AS last_value,
               round(current_drawdown, 7) + 0 AS current_drawdown, breaches,
               coalesce(stop_losses, 0) AS stop_losses, coalesce(take_profits, 0) AS take_profits
        FROM g LEFT JOIN ts USING (symbol)""",
    ),
)
def risk_summary(spark, sf):
    days = m.with_drawdown(marked_days(spark, sf), ["symbol"], "value")
    done = pos.risk_summary(days, pos.trade_stats(ledger(spark, sf)), 0.2)
    return out(
        done, ["symbol"], "peak", "last_value", "current_drawdown", "breaches", "stop_losses", "take_profits", digits=7
    )


@query(
    "portfolio_view",
    sql(
        "bars_1h",
        f"""WITH {_STOPPED}, {LEDGER_CTES}, {MARK_CTES},
        v AS (SELECT *, CAST(coalesce(position - lag(position) OVER ({_DAYW}), 0) AS INTEGER) AS position_change FROM mr)
        SELECT symbol, day, position, position_change, CASE WHEN position_change > 0 THEN 'BUY'
               WHEN position_change < 0 THEN 'SELL' ELSE 'WAIT' END AS direction, CAST(sign(position_change) AS INTEGER) AS signal,
               round(product(1 + coalesce(ret, 0)) OVER ({_DAYW} ROWS UNBOUNDED PRECEDING) - 1, 6) + 0 AS cumulative_return,
               round(value - 100000, 7) + 0 AS pnl FROM v""",
    ),
)
def portfolio_view(spark, sf):
    view = pos.portfolio_view(marked_days(spark, sf))
    return view.select(
        *DAY,
        "position",
        "position_change",
        "direction",
        "signal",
        F.round("cumulative_return", 6).alias("cumulative_return"),
        F.round("pnl", 7).alias("pnl"),
    )
