"""Positions, exits, trade ledger and daily equity as running operators over bars.

All state that passes from bar to bar here is a forward fill or a running sum, so a position may
stay open over any number of days and blocks without one task reading the whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.numeric import ratio, trunc
from barloom.functions.risk import EXIT_SIGNAL, EXIT_STOP, EXIT_TARGET, pnl_pct
from barloom.operators.series import BARS, Layout, Scan, blocked_scan


def _day(layout: Layout):
    return W.partitionBy(*layout.keys, "day").orderBy(*layout.order)


def previous(df: DataFrame, layout: Layout = BARS, **values: Column) -> DataFrame:
    """``_prev``: a struct of the previous row's values, across blocks."""
    row = F.struct(*[c.alias(n) for n, c in values.items()])
    return blocked_scan(df, [Scan("_prev", "last", row, exclusive=True)], layout)


def decision_mask(df: DataFrame, minutes: int | Column, layout: Layout = BARS) -> DataFrame:
    """``decision``: every k-th bar of the day, k = minutes over the spacing of its first two bars."""
    w = _day(layout)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = F.row_number().over(w)
    spacing = F.coalesce(F.nth_value("min_from_open", 2).over(whole) - F.first("min_from_open").over(whole), F.lit(1))
    freq = minutes if isinstance(minutes, Column) else F.lit(minutes)
    step = F.greatest(F.lit(1), F.floor(freq / F.nullif(spacing, F.lit(0))))
    return df.withColumn("decision", F.coalesce((n - 1) % step == 0, F.lit(True)))


def every_kth(df: DataFrame, k: int, layout: Layout = BARS) -> DataFrame:
    """``decision`` by bar count."""
    return df.withColumn("decision", (F.row_number().over(_day(layout)) - 1) % k == 0)


def local_state(df: DataFrame, signal: Column, layout: Layout = BARS) -> DataFrame:
    """``_state``: the position the day's own signals lead to, NULL while none has executed yet.

    An order of one decision bar executes at the next one of the same day; what is pending at
    the end of the day is dropped.
    """
    w = _day(layout)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    ordered = F.when(F.col("decision") & (signal != 0), (signal == 1).cast("int"))
    told = df.withColumn("_told", F.last(ordered, ignorenulls=True).over(upto))
    due = told.withColumn("_due", F.when(F.col("decision"), F.lag("_told").over(w)))
    return due.withColumn("_state", F.last("_due", ignorenulls=True).over(upto)).drop("_told", "_due")


def latch_position(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    """``position`` 0/1 from ``signal`` and ``decision``; carries overnight.

    The first day of a series is never traded. A day is reduced to the state it ends in; the
    chain of these states over the days of a series tells each day where it starts.
    """
    keys = [*layout.keys, "day"]
    states = local_state(df, F.col("signal"), layout)
    series = W.partitionBy(*layout.keys)
    traded = F.col("day") > F.min("day").over(series)
    earlier = series.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = (
        states.groupBy(*keys)
        .agg(F.max_by("_state", layout.order_value()).alias("_end"))
        .withColumn("_trade", traded)
        .withColumn("_start", F.last(F.when(F.col("_trade"), F.col("_end")), ignorenulls=True).over(earlier))
        .drop("_end")
    )
    position = F.when(F.col("_trade"), F.coalesce("_state", "_start", F.lit(0))).otherwise(0)
    return states.join(days, keys).withColumn("position", position).drop("_state", "_start", "_trade")


def runs(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    """``run_id`` numbers the stretches of consecutive in-position bars; NULL while flat.

    Also adds ``entry_price`` and ``entry_ts`` of the run. Inside a block, runs are counted as if
    the block started flat; a block whose first run continues the previous block's last one
    is corrected by one.
    """
    w = layout.window()
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    entry = F.struct(F.col("close").alias("price"), F.col(layout.order[0]).alias("ts"))
    enter = (F.col("position") == 1) & (F.coalesce(F.lag("position").over(w), F.lit(0)) == 0)
    local = df.withColumn("_enter", enter).withColumns(
        {
            "_nth": F.sum(F.col("_enter").cast("bigint")).over(upto),
            "_entry": F.last(F.when(F.col("_enter"), entry), ignorenulls=True).over(upto),
        }
    )
    if layout.block is None:
        numbered_runs = local.withColumns({"_run": F.col("_nth"), "_from": F.col("_entry")})
    else:
        order = layout.order_value()
        series = W.partitionBy(*layout.keys).orderBy(layout.block)
        earlier = series.rowsBetween(W.unboundedPreceding, -1)
        own = F.col("_count") - F.col("_continues")
        blocks = (
            local.groupBy(*layout.block_keys)
            .agg(
                F.min_by("position", order).alias("_first"),
                F.max_by("position", order).alias("_last"),
                F.sum(F.col("_enter").cast("bigint")).alias("_count"),
                F.max_by("_entry", order).alias("_latest"),
            )
            .withColumn(
                "_continues",
                ((F.col("_first") == 1) & (F.coalesce(F.lag("_last").over(series), F.lit(0)) == 1)).cast("bigint"),
            )
            .select(
                *layout.block_keys,
                "_continues",
                F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("_base"),
                F.last(F.when(own > 0, F.col("_latest")), ignorenulls=True).over(earlier).alias("_carried"),
            )
        )
        here = F.col("_nth") - F.col("_continues")
        numbered_runs = local.join(blocks, layout.block_keys).withColumns(
            {
                "_run": F.col("_base") + here,
                "_from": F.when(here > 0, F.col("_entry")).otherwise(F.col("_carried")),
            }
        )
    held = F.col("position") == 1
    return numbered_runs.withColumns(
        {
            "run_id": F.when(held, F.col("_run")),
            "entry_price": F.when(held, F.col("_from.price")),
            "entry_ts": F.when(held, F.col("_from.ts")),
        }
    ).select(*df.columns, "run_id", "entry_price", "entry_ts")


def barrier_exit(
    df: DataFrame, stop_loss: float, take_profit: float, layout: Layout = BARS, pnl: Column | None = None
) -> DataFrame:
    """Cut every run at its first bar beyond a barrier; the position is 0 from that bar on.

    Adds ``exit_reason`` at the bar where a run ends: 1 signal, 2 stop, 3 target. One trade per
    run: there is no second entry inside the same run. ``pnl`` replaces the price-based profit.
    Run numbers grow, so "the latest run that was cut" is a running maximum.
    """
    gain = pnl if pnl is not None else pnl_pct("close", "entry_price")
    w = layout.window()
    hit = F.when(F.col("run_id").isNotNull(), _barrier(gain, stop_loss, take_profit)).otherwise(0)
    cut = F.max(F.when(F.col("_hit") > 0, F.col("run_id"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    local = df.withColumn("_hit", hit).withColumn("_cut", cut)
    alive = lambda run, latest: F.col(run).isNotNull() & F.coalesce(latest != F.col(run), F.lit(True))
    if layout.block is None:
        joined = local.withColumns({"_cut_in": F.lit(None).cast("bigint"), "_held_in": F.lit(0)})
    else:
        series = W.partitionBy(*layout.keys).orderBy(layout.block)
        blocks = (
            local.groupBy(*layout.block_keys)
            .agg(
                F.max(F.when(F.col("_hit") > 0, F.col("run_id"))).alias("_cut"),
                F.max_by(F.struct("run_id"), layout.order_value()).alias("_end"),
            )
            .withColumn("_run", F.col("_end.run_id"))
            .withColumn("_cut_in", F.max("_cut").over(series.rowsBetween(W.unboundedPreceding, -1)))
            .withColumn("_ends_held", alive("_run", F.greatest("_cut", "_cut_in")).cast("int"))
            .select(*layout.block_keys, "_cut_in", F.lag("_ends_held").over(series).alias("_held_in"))
        )
        joined = local.join(blocks, layout.block_keys)
    held = joined.withColumn("_held", alive("run_id", F.greatest("_cut", "_cut_in")).cast("int"))
    was = F.coalesce(F.lag("_held").over(w), F.col("_held_in"), F.lit(0)) == 1
    ends = held.withColumn("_ends", was & (F.col("_held") == 0))
    reason = F.when(~F.col("_ends"), 0).when(F.col("run_id").isNotNull(), F.col("_hit")).otherwise(EXIT_SIGNAL)
    return ends.withColumns({"position": F.col("_held"), "exit_reason": reason}).select(*df.columns, "exit_reason")


def _barrier(gain: Column, stop_loss: float, take_profit: float) -> Column:
    return F.when(gain <= -stop_loss, EXIT_STOP).when(gain >= take_profit, EXIT_TARGET).otherwise(0)


def spread_pnl(spread: str = "spread", entry: str = "entry_spread") -> Column:
    return ratio(F.col(spread) - F.col(entry), F.abs(F.col(entry)))


def trade_ledger(
    df: DataFrame,
    capital: float = 100_000.0,
    size: float | Column = 1.0,
    slippage_bps: float = 0.1,
    commission: float = 0.0035,
    layout: Layout = BARS,
) -> DataFrame:
    """One row per buy and per sell of a run.

    Shares are sized on the initial capital: the smaller of the wanted and of the affordable
    number at 99 % of it. Expects position, run_id, entry_price and exit_reason.
    """
    slip = slippage_bps / 10_000.0
    share = size if isinstance(size, Column) else F.lit(float(size))
    before = previous(df, layout, pos=F.col("position"), entry=F.col("entry_price"))
    was = F.coalesce(F.col("_prev.pos"), F.lit(0))
    buy, sell = (F.col("position") == 1) & (was == 0), (F.col("position") == 0) & (was == 1)
    trades = before.withColumn("side", F.when(buy, "BUY").when(sell, "SELL")).where(F.col("side").isNotNull())
    bought = F.col("side") == "BUY"
    entry = F.col("close") if isinstance(size, Column) else F.when(bought, F.col("close")).otherwise(F.col("_prev.entry"))
    paid = entry * (1 + slip)
    wanted = F.least(trunc(capital * 0.99 / (paid + commission)), trunc(ratio(capital * share, paid)))
    if isinstance(size, Column):
        # The size varies, so a sale looks up what the latest purchase bought.
        sized = trades.withColumn("_want", F.when(bought, wanted))
        sized = blocked_scan(sized, [Scan("shares", "last", F.col("_want"))], layout)
    else:
        sized = trades.withColumn("shares", wanted)
    value = F.col("shares") * F.col("close")
    costs = F.col("slippage") + F.col("commission")
    extra = [c for c in ("exit_reason",) if c in df.columns]
    return (
        sized.where(F.col("shares") > 0)
        .withColumns({"slippage": value * slip, "commission": F.col("shares") * commission})
        .withColumn("cash_flow", F.when(F.col("side") == "BUY", -(value + costs)).otherwise(value - costs))
        .select(
            *layout.keys, *layout.order, "day", "side", "close", "shares", "slippage", "commission", "cash_flow", *extra
        )
    )


def mark_to_market(
    bars: DataFrame, ledger: DataFrame, capital: float = 100_000.0, layout: Layout = BARS
) -> DataFrame:
    """Cash, shares and portfolio value at every bar."""
    keys = [*layout.keys, *layout.order]
    flows = ledger.select(
        *keys,
        "cash_flow",
        F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares")).alias("_delta"),
    )
    joined = bars.join(flows, keys, "left")
    scans = [Scan("_cash", "sum", F.col("cash_flow")), Scan("_shares", "sum", F.col("_delta"))]
    return (
        blocked_scan(joined, scans, layout)
        .withColumns(
            {
                "cash": capital + F.coalesce("_cash", F.lit(0.0)),
                "shares": F.coalesce("_shares", F.lit(0)),
            }
        )
        .withColumn("value", F.col("cash") + F.col("shares") * F.col("close"))
        .drop("_cash", "_shares", "cash_flow", "_delta")
    )


def bar_returns(df: DataFrame, cost: float = 0.0, size: float | Column = 1.0, layout: Layout = BARS) -> DataFrame:
    """``bar_ret``: previous position times the price change, less cost per change of position."""
    share = size if isinstance(size, Column) else F.lit(float(size))
    before = previous(df, layout, pos=F.col("position"), close=F.col("close"))
    was = F.coalesce(F.col("_prev.pos"), F.lit(0))
    change = F.coalesce(ratio("close", F.col("_prev.close")) - 1, F.lit(0.0))
    return before.withColumn("bar_ret", was * share * change - cost * F.abs(F.col("position") - was)).drop("_prev")


def strategy_returns(df: DataFrame, cost: float = 0.0, size: float | Column = 1.0, layout: Layout = BARS) -> DataFrame:
    """Daily return: the bar returns of the day compounded."""
    return (
        bar_returns(df, cost, size, layout)
        .groupBy(*layout.keys, "day")
        .agg((F.product(1 + F.col("bar_ret")) - 1).alias("ret"))
    )


def ledger_returns(marked: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Daily return of the marked portfolio, from its last value of each day."""
    daily = marked.groupBy(*layout.keys, "day").agg(
        F.max_by("value", layout.order_value()).alias("value"),
        F.max_by("shares", layout.order_value()).alias("shares"),
    )
    w = W.partitionBy(*layout.keys).orderBy("day")
    return daily.withColumn("ret", ratio("value", F.lag("value").over(w)) - 1)


def drawdown_breaker(
    daily: DataFrame, limit: float | Column, keys: Sequence[str] = ("symbol",), ret="ret", start: float = 1.0
) -> DataFrame:
    """Flat for good from the first day on which yesterday's equity is too far below its peak.

    What is held on that day is sold at its close, so the day's own return still counts.
    """
    w = W.partitionBy(*keys).orderBy("day")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    lim = limit if isinstance(limit, Column) else F.lit(float(limit))
    r = F.coalesce(F.col(ret), F.lit(0.0))
    eq = daily.withColumn("_eq", start * F.product(1 + r).over(upto))
    prior = eq.withColumn("_prior", F.coalesce(F.lag("_eq").over(w), F.lit(start)))
    peak = F.greatest(F.max("_prior").over(upto), F.lit(start))
    dd = prior.withColumn("drawdown", (F.col("_prior") - peak) / peak)
    breached = dd.withColumn("_b", (F.abs(F.col("drawdown")) > lim).cast("int"))
    stopped = F.coalesce(F.max("_b").over(before), F.lit(0)) == 1
    return (
        breached.withColumns({"halted": F.max("_b").over(upto), "_stop": stopped})
        .withColumn(ret, F.when(F.col("_stop"), 0.0).otherwise(F.col(ret)))
        .drop("_eq", "_prior", "_b", "_stop")
    )


def vol_rebalance_flag(
    daily: DataFrame,
    threshold: float = 0.25,
    min_change: float = 0.10,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Held days on which size and target shares both moved enough to rebalance.

    Expects position, size_factor, shares, value and close per day.
    """
    w = W.partitionBy(*keys).orderBy("day")
    target = trunc(ratio(F.col("value") * F.col("size_factor"), "close"))
    last = F.lag(F.when(F.col("position") == 1, F.col("size_factor")).otherwise(0.0)).over(w)
    size_change = ratio(F.abs(F.col("size_factor") - last), last)
    share_change = ratio(F.abs(F.col("target_shares") - F.col("shares")).cast("double"), F.col("shares").cast("double"))
    held = (F.col("position") == 1) & (F.col("shares") > 0)
    fires = held & (size_change >= threshold) & (share_change >= min_change)
    return daily.withColumn("target_shares", target).withColumn(
        "rebalance", F.coalesce(fires, F.lit(False)).cast("int")
    )


def trade_stats(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Buys, sells and barrier exits of a ledger."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(F.col("side") == "BUY").alias("buy_trades"),
        F.count_if(F.col("side") == "SELL").alias("sell_trades"),
        F.count_if((F.col("side") == "SELL") & (F.col("exit_reason") == EXIT_STOP)).alias("stop_losses"),
        F.count_if((F.col("side") == "SELL") & (F.col("exit_reason") == EXIT_TARGET)).alias("take_profits"),
    )


def risk_summary(daily: DataFrame, stats: DataFrame, limit: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Peak, current drawdown, barrier exits and drawdown breaches per group."""
    risk = daily.groupBy(*keys).agg(
        F.max("value").alias("peak"),
        F.max_by("value", "day").alias("last_value"),
        F.max_by("drawdown", "day").alias("current_drawdown"),
        F.count_if(F.abs(F.col("drawdown")) > limit).alias("breaches"),
    )
    return risk.join(stats.select(*keys, "stop_losses", "take_profits"), list(keys), "left").na.fill(
        0, ["stop_losses", "take_profits"]
    )


def latch_probability(
    df: DataFrame, buy: float = 0.55, sell: float = 0.45, layout: Layout = BARS, probability="probability"
) -> DataFrame:
    """``signal`` with hysteresis: 1 when a flat series reaches ``buy``, -1 when a held one falls
    to ``sell``. Rows without a probability hold. Needs buy > sell."""
    if buy <= sell:
        raise ValueError("buy must be above sell")
    p = F.col(probability)
    return _latch(df, F.when(p >= buy, 1).when(p <= sell, 0), layout)


def latch_prediction(df: DataFrame, layout: Layout = BARS, prediction="prediction") -> DataFrame:
    """The same latch on predicted classes 1 and 0."""
    c = F.col(prediction)
    return _latch(df, F.when(c == 1, 1).when(c == 0, 0), layout)


def _latch(df: DataFrame, wanted: Column, layout: Layout) -> DataFrame:
    want = df.withColumn("_want", wanted)
    scans = [
        Scan("_state", "last", F.col("_want")),
        Scan("_was", "last", F.col("_want"), exclusive=True),
    ]
    change = F.coalesce("_state", F.lit(0)) - F.coalesce("_was", F.lit(0))
    return blocked_scan(want, scans, layout).withColumn("signal", change.cast("int")).drop("_want", "_state", "_was")


def portfolio_view(df: DataFrame, capital: float = 100_000.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily position change, direction, signal, profit and cumulative return.

    Expects position, ret and value per day.
    """
    w = W.partitionBy(*keys).orderBy("day")
    change = F.coalesce(F.col("position") - F.lag("position").over(w), F.lit(0))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns(
        {
            "position_change": change,
            "cumulative_return": F.product(1 + F.coalesce("ret", F.lit(0.0))).over(upto) - 1,
            "pnl": F.col("value") - capital,
        }
    ).withColumns(
        {
            "direction": F.when(F.col("position_change") > 0, "BUY")
            .when(F.col("position_change") < 0, "SELL")
            .otherwise("WAIT"),
            "signal": F.signum(F.col("position_change")).cast("int"),
        }
    )
