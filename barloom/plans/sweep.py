"""Parameter sweeps: every configuration on every symbol, as one job.

A configuration multiplies bars, so the multiplied rows must never be shuffled. The configurations
of a large grid are dealt over buckets and bars are copied once a bucket, so a task sorts the bars of
a (symbol, day) times those configurations that share a bucket, whatever the grid. Bars are
partitioned by (symbol, day, bucket) once; configurations are exploded inside those partitions; and
each (configuration, symbol, day) is reduced to one row that says how the day maps the position it
starts with to a return and to the position it ends with. Only these rows travel. Chaining them
over the days of a series is a small window problem.

Barriers need the entry price of a position held overnight. It comes from a first pass that ignores
barriers (they never move the start of a run, because a run has one trade) and is handed to the
second pass as one array per (symbol, day, bucket), as long as the bucket. What barriers look at is
the close, or for pairs the spread under the configuration's own hedge.

Daily return = size factor of the day x unit return of the day. Kelly sizes look at earlier unit
returns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions import signals as sig
from barloom.functions.numeric import ratio
from barloom.functions.risk import EXIT_STOP, EXIT_TARGET
from barloom.operators import indicators as ind
from barloom.operators import recurrence as rec
from barloom.operators import sizing
from barloom.operators.joins import asof_risk_free, join_prev_day
from barloom.operators.metrics import best_rows, strategy_report
from barloom.operators.positions import drawdown_breaker
from barloom.operators.selection import in_session
from barloom.operators.series import DAY, over_chunks, spread
from barloom.plans.grids import COMMON_DEFAULTS, ParamGrid, check_names, pick

_GROUP = ["symbol", "day", "bucket", "config_id"]

_KEYS = ["symbol", "day", "config_id"]
BUCKET = 512
"""Configurations that a task lays over the bars of one symbol and day."""

# A Column, or a function from the multiplied bars to the same with a column ``_sig``.
Signal = Column | Callable[[DataFrame], DataFrame]


def param(grid: ParamGrid, name: str) -> Column:
    """A parameter of the configuration, or its default where the grid does not vary it."""
    return F.col(name) if name in grid.params else F.lit(COMMON_DEFAULTS[name])


def prepare(bars: DataFrame, daily: DataFrame, keep: Sequence[str], sessions: DataFrame | None = None) -> DataFrame:
    """Tradable bars: those after the first day, with their price change and place in the day.

    With ``sessions`` (see ``calendar.sessions``) closed days and bars after an early close are left out, and the change
    of a day's first bar runs from the last bar that was left in. Reference prices of signals stay those of the day before.
    """
    w = W.partitionBy("symbol", "day").orderBy("ts")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    days = daily.select("symbol", "day", "open", "close", *_dividend(daily))
    dealt_bars = spread(bars, "symbol", "day")
    held = F.col("prev_close")
    if sessions is not None:
        dealt_bars = in_session(dealt_bars, sessions)
        ends = dealt_bars.groupBy("symbol", "day").agg(F.max_by("close", "ts").alias("_end"))
        earlier = F.lag("_end").over(W.partitionBy("symbol").orderBy("day"))
        dealt_bars = dealt_bars.join(ends.select("symbol", "day", earlier.alias("_held")), ["symbol", "day"])
        held = F.coalesce("_held", "prev_close")
    base = join_prev_day(dealt_bars, days)
    first = F.first("min_from_open").over(whole)
    spacing = F.coalesce(F.nth_value("min_from_open", 2).over(whole) - first, F.lit(1))
    before = F.coalesce(F.lag("close").over(w), held)
    return base.select(
        "symbol",
        "day",
        "ts",
        "close",
        (ratio("close", before) - 1).alias("change"),
        (F.row_number().over(w) - 1).alias("bar"),
        F.nullif(spacing, F.lit(0)).alias("spacing"),
        *[F.col(c) for c in keep],
    )


def _dividend(daily: DataFrame) -> list[str]:
    return ["dividend"] if "dividend" in daily.columns else []


def _buckets(grid: ParamGrid, size: int) -> int:
    return max(1, -(-grid.size // size))


def dealt(base: DataFrame, grid: ParamGrid, size: int = BUCKET) -> DataFrame:
    """Prepared bars once per bucket of ``size`` configurations, partitioned by symbol, day and bucket."""
    if _buckets(grid, size) == 1:
        return base.withColumn("bucket", F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.lit(_buckets(grid, size) - 1)))
    return spread(base.withColumn("bucket", copies), "symbol", "day", "bucket")


def chosen_only(base: DataFrame, only: DataFrame) -> DataFrame:
    """Prepared bars with the configurations ``only`` (symbol, config_id) asks for as an array ``_ids``; other symbols go.

    The arrays travel by symbol and day, where bars are partitioned, so a hot symbol is not one task.
    """
    ids = only.groupBy("symbol").agg(F.sort_array(F.collect_set("config_id")).alias("_ids"))
    days = base.select("symbol", "day").distinct().join(ids, "symbol")
    return base.join(days.hint("merge"), ["symbol", "day"]).withColumn("bucket", F.lit(0))


def _multiplied(base: DataFrame, grid: ParamGrid, size: int) -> DataFrame:
    """Every bar once per configuration of its bucket, with the parameters. A narrow step."""
    if "_ids" in base.columns:
        ids = F.col("_ids")
    else:
        first = F.col("bucket") * size
        ids = F.sequence(first, F.least(first + size, F.lit(grid.size)) - 1)
    rows = base.withColumn("config_id", F.explode(ids.cast("array<int>"))).drop("_ids")
    return grid.with_params(rows)


def _local(rows: DataFrame, signal: Signal, freq: Column) -> DataFrame:
    """``_state`` of every multiplied bar; see ``positions.local_state`` for the rule."""
    w = W.partitionBy(*_GROUP).orderBy("bar")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    step = F.greatest(F.lit(1), F.floor(freq / F.col("spacing")))
    due = F.coalesce(F.col("bar") % step == 0, F.lit(True))
    signed = signal(rows) if callable(signal) else rows.withColumn("_sig", signal)
    dec = signed.withColumn("_dec", due)
    ordered = F.when(F.col("_dec") & (F.col("_sig") != 0), (F.col("_sig") == 1).cast("int"))
    told = dec.withColumn("_told", F.last(ordered, ignorenulls=True).over(upto))
    dued = told.withColumn("_due", F.when(F.col("_dec"), F.lag("_told").over(w)))
    return dued.withColumn("_state", F.last("_due", ignorenulls=True).over(upto))


def _chain(days: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Forward-fill day results into the following day."""
    w = W.partitionBy("config_id", "symbol").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    return days.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in columns.items()})


def unit_returns(
    base: DataFrame, grid: ParamGrid, signal: Signal, cost: float, stops: bool, gauge: Column | None = None, size: int = BUCKET
) -> DataFrame:
    """One row per (configuration, symbol, day): unit return, trades and exits.

    ``base`` comes from ``dealt`` or ``chosen_only``. Barriers look at the move of ``gauge`` since the entry, over its
    size at the entry; it may use parameters. Without it they look at the close.
    """
    mark = F.col("close") if gauge is None else gauge
    freq = param(grid, "trade_freq")
    w = W.partitionBy(*_GROUP).orderBy("bar")
    upto = w.rowsBetween(W.unboundedPreceding, 0)

    # First pass: where does each day leave the position, and at which price was it entered?
    first = _local(_multiplied(base, grid, size).withColumn("_mark", F.struct(mark.alias("at"))), signal, freq)
    was0, was1 = F.coalesce(F.lag("_state").over(w), F.lit(0)), F.coalesce(F.lag("_state").over(w), F.lit(1))
    held0, held1 = F.coalesce(F.col("_state"), F.lit(0)), F.coalesce(F.col("_state"), F.lit(1))
    first = first.withColumns({"_was0": was0, "_was1": was1, "_held0": held0, "_held1": held1})
    enters = lambda v: (F.col(f"_held{v}") == 1) & (F.col(f"_was{v}") == 0)
    leaves = lambda v: (F.col(f"_held{v}") == 0) & (F.col(f"_was{v}") == 1)
    gain = lambda v: F.product(
        1 + F.col(f"_was{v}") * F.col("change") - cost * F.abs(F.col(f"_held{v}") - F.col(f"_was{v}"))
    )
    ends = [F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("bar"))).alias("end_state")]
    for v in (0, 1):
        # a struct, so that an entry without a value is an entry all the same
        ends.append(F.max_by("_mark", F.when(enters(v), F.col("bar"))).alias(f"entry{v}"))
        if not stops:
            ends += [
                gain(v).alias(f"gain{v}"),
                F.count_if(enters(v)).alias(f"buys{v}"),
                F.count_if(leaves(v)).alias(f"sells{v}"),
            ]
    days = first.groupBy(*_GROUP).agg(*ends)
    days = _chain(days, {"start": F.col("end_state")}).withColumn("start", F.coalesce("start", F.lit(0)))
    chosen = lambda name: F.when(F.col("start") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    if not stops:
        return days.select(
            *_KEYS,
            (chosen("gain") - 1).alias("unit_ret"),
            chosen("buys").alias("buys"),
            chosen("sells").alias("sells"),
            F.lit(0).cast("bigint").alias("stop_losses"),
            F.lit(0).cast("bigint").alias("take_profits"),
            F.coalesce("end_state", "start").alias("position"),
        )

    # Second pass: the start of the day is known, so barriers can be evaluated bar by bar.
    days = _chain(days, {"entry": chosen("entry")})
    starts = days.groupBy("symbol", "day", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("config_id", "start", "entry"))).alias("_starts")
    )
    # Spark takes an array for one element: without the hint, arrays as long as the grid would look small enough to broadcast
    rows = base.drop("_ids").join(starts.hint("merge"), ["symbol", "day", "bucket"]).withColumn("_at", F.explode("_starts"))
    rows = rows.select(*(c for c in base.columns if c != "_ids"), "_at.config_id", "_at.start", "_at.entry")
    rows = _local(grid.with_params(rows).withColumn("_mark", F.struct(mark.alias("at"))), signal, freq)
    rows = rows.withColumn("_pos", F.coalesce("_state", "start"))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_pos").over(w), F.col("start")))
    enter = (F.col("_pos") == 1) & (F.col("_was") == 0)
    rows = rows.withColumns(
        {
            "_run": F.sum(enter.cast("int")).over(upto),
            "_px": F.coalesce(F.last(F.when(enter, F.col("_mark")), ignorenulls=True).over(upto), F.col("entry")),
        }
    )
    entered = F.col("_px.at")
    pnl = ratio(F.col("_mark.at") - entered, entered if gauge is None else F.abs(entered))
    stop, target = param(grid, "stop_loss_pct"), param(grid, "take_profit_pct")
    why = F.when(pnl <= -stop, EXIT_STOP).when(pnl >= target, EXIT_TARGET)
    rows = rows.withColumn("_why", F.when(F.col("_pos") == 1, why))
    rows = rows.withColumn("_cut", F.max(F.when(F.col("_why").isNotNull(), F.col("_run"))).over(upto))
    alive = (F.col("_pos") == 1) & ~F.coalesce(F.col("_cut") == F.col("_run"), F.lit(False))
    rows = rows.withColumns(
        {"_held1": alive.cast("int"), "_held0": (alive & (F.col("_run") > 0)).cast("int")}
    ).withColumns(
        {
            "_was1": F.coalesce(F.lag("_held1").over(w), F.col("start")),
            "_was0": F.coalesce(F.lag("_held0").over(w), F.lit(0)),
        }
    )
    ends = [
        F.max_by("_pos", "bar").alias("end_pos"),
        F.max_by("_run", "bar").alias("end_run"),
        F.max_by("_cut", "bar").alias("end_cut"),
        F.max(F.when(F.col("_run") == 0, F.col("_why").isNotNull().cast("int"))).alias("carried_hit"),
        F.max("start").alias("start"),
    ]
    for v in (0, 1):
        ends += [
            gain(v).alias(f"gain{v}"),
            F.count_if(enters(v)).alias(f"buys{v}"),
            F.count_if(leaves(v)).alias(f"sells{v}"),
            F.count_if(leaves(v) & (F.col("_why") == EXIT_STOP)).alias(f"stops{v}"),
            F.count_if(leaves(v) & (F.col("_why") == EXIT_TARGET)).alias(f"targets{v}"),
        ]
    days = rows.groupBy(*_GROUP).agg(*ends)
    # Is the run that a day inherits already cut? A run opened that day resets the answer.
    fresh = (F.col("end_pos") == 1) & (F.col("end_run") > 0)
    dead = F.when(fresh, F.coalesce(F.col("end_cut") == F.col("end_run"), F.lit(False)).cast("int")).when(
        F.col("carried_hit") == 1, 1
    )
    days = _chain(days, {"_dead": dead})
    live = (F.col("start") == 1) & (F.coalesce(F.col("_dead"), F.lit(0)) == 0)
    chosen = lambda name: F.when(live, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    still = F.when(
        F.col("end_run") > 0, ~F.coalesce(F.col("end_cut") == F.col("end_run"), F.lit(False))
    ).otherwise(live & (F.coalesce(F.col("carried_hit"), F.lit(0)) == 0))
    return days.select(
        *_KEYS,
        (chosen("gain") - 1).alias("unit_ret"),
        chosen("buys").alias("buys"),
        chosen("sells").alias("sells"),
        chosen("stops").alias("stop_losses"),
        chosen("targets").alias("take_profits"),
        ((F.col("end_pos") == 1) & still).cast("int").alias("position"),
    )


def sized_days(days: DataFrame, grid: ParamGrid, daily: DataFrame, rates: DataFrame | None) -> DataFrame:
    """Strategy rows per day: sized return after the drawdown halt, benchmark and risk-free rate."""
    keys = ("config_id", "symbol")
    full = grid.with_params(days)
    if "ticker_dvol" in daily.columns:
        full = full.join(daily.select("symbol", "day", "ticker_dvol"), ["symbol", "day"], "left")
    else:
        full = full.withColumn("ticker_dvol", F.lit(None).cast("double"))
    unit = F.col("unit_ret")
    # one pair of columns for each history that some configuration looks at
    values = lambda name: list(dict.fromkeys(grid.params.get(name, [COMMON_DEFAULTS[name]])))
    raw, enough = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), F.lit(False))
    made = {}
    for least in values("kelly_min_trades"):
        own = param(grid, "kelly_min_trades") == least
        made[f"_enough{least}"] = sizing.enough_history(unit, keys, least, skip=1)
        enough = enough.when(own, F.col(f"_enough{least}"))
        for days_back in values("kelly_lookback"):
            made[f"_kelly{days_back}_{least}"] = sizing.kelly_raw(unit, keys, days_back, least, skip=1)
            raw = raw.when(own & (param(grid, "kelly_lookback") == days_back), F.col(f"_kelly{days_back}_{least}"))
    full = full.withColumns(made)
    size = sizing.size_factor(
        param(grid, "sizing_type"),
        F.col("ticker_dvol"),
        param(grid, "target_vol"),
        raw,
        enough,
        param(grid, "kelly_fraction"),
        param(grid, "max_leverage"),
        param(grid, "kelly_vol_blend_weight"),
    )
    full = full.withColumn("size_factor", size).withColumn("ret", F.col("size_factor") * unit)
    halted = drawdown_breaker(full, param(grid, "drawdown_limit"), keys)
    stopped = (F.col("halted") == 1) & (F.col("ret") == 0.0)
    counts = {c: F.when(stopped, 0).otherwise(F.col(c)) for c in ("buys", "sells", "stop_losses", "take_profits")}
    # Every traded day is in ``daily``, so benchmark and rate are looked up there, not from the sweep.
    w = W.partitionBy("symbol").orderBy("day")
    bench = daily.withColumn("ret_ticker", ratio("close", F.lag("close").over(w)) - 1)
    bench = bench.withColumn("rf_daily", F.lit(0.0)) if rates is None else asof_risk_free(bench, rates)
    out = halted.withColumns(counts).join(
        bench.select("symbol", "day", "ret_ticker", "rf_daily"), ["symbol", "day"], "left"
    )
    return out.drop(*made, "drawdown", "ticker_dvol", *grid.params)


def report(days: DataFrame, grid: ParamGrid, rf_annual: float = 0.0) -> DataFrame:
    """The sweep table: one row per configuration and symbol with parameters and statistics."""
    trades = {c: F.sum(c) for c in ("buys", "sells", "stop_losses", "take_profits")}
    return grid.with_params(strategy_report(days, ["config_id", "symbol"], rf_annual, trades))


def sweep(
    bars: DataFrame,
    daily: DataFrame,
    grid: ParamGrid,
    signal: Signal,
    keep: Sequence[str],
    cost: float = 0.0,
    rates: DataFrame | None = None,
    rf_annual: float = 0.0,
    barriers: bool = True,
    strategy: str | None = None,
    gauge: Column | None = None,
    size: int = BUCKET,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Statistics of every configuration.

    ``signal`` is a Column over bar columns and parameters, or a function that adds ``_sig``. Stop and target are
    those of the grid or the defaults; only ``barriers=False`` switches them off. Names that ``strategy`` (without one,
    any strategy) does not know are an error. ``size`` configurations share a bucket; results do not depend on it.
    ``sessions`` says which days and bars are traded.
    """
    how = {"strategy": strategy, "gauge": gauge, "size": size, "sessions": sessions}
    return report(sweep_days(bars, daily, grid, signal, keep, cost, rates, barriers, **how), grid, rf_annual)


def sweep_days(
    bars, daily, grid, signal, keep, cost=0.0, rates=None, barriers=True, strategy=None, gauge=None, size=BUCKET, only=None, sessions=None
) -> DataFrame:
    """Strategy rows per configuration, symbol and day; with ``only`` (symbol, config_id) of those configurations alone."""
    check_names(grid.params, strategy)
    base = prepare(bars, daily, keep, sessions)
    base = dealt(base, grid, size) if only is None else chosen_only(base, only)
    return sized_days(unit_returns(base, grid, signal, cost, barriers, gauge, size), grid, daily, rates)


# ---------------------------------------------------------------- the six strategies


def momentum_inputs(bars: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """Bars with vwap and sigma_open; days without any sigma are not traded."""
    whole = W.partitionBy("symbol", "day")
    known = bars.withColumn("_known", F.count("sigma_open").over(whole)).where(F.col("_known") > 0).drop("_known")
    high, low = sig.reference_prices()
    signal = sig.momentum("band_mult", high, low)
    return known, signal, ["vwap", "sigma_open", "day_open", "prev_close", "prev_dividend"]


def momentum_atr_inputs(bars: DataFrame, periods: Sequence[int], lookback: int = 14):
    stages, step = ind.atr_stages(periods)
    ready = over_chunks(bars, [*stages, lambda f: {k[1:]: c for k, c in ind.range_stage(lookback)(f).items()}], DAY, step=step)
    pad = F.col("atr_mult") * pick("atr_", "atr_period", periods) * ind.BAND_BUFFER
    signal = sig.band_breakout(F.col("hi") + pad, F.col("lo") - pad)
    return ready, signal, ["vwap", "hi", "lo", *[f"atr_{p}" for p in periods]]


def mean_reversion_inputs(bars: DataFrame, lookbacks: Sequence[int]):
    ready = ind.zscore_lagged(bars, lookbacks, DAY)
    z = pick("z_", "zscore_lookback", lookbacks)
    exit_at = F.col("exit_threshold")
    return ready, sig.mean_reversion("n_std_upper", "n_std_lower", exit_at, z), [f"z_{n}" for n in lookbacks]


def rsi_inputs(bars: DataFrame, periods: Sequence[int], averages: Sequence[int]):
    stages, coefs = [], []
    for p in periods:
        part, recs = ind.rsi_wilder_stages(p, f"rsi_{p}")
        stages += part
        coefs += [r.c for r in recs]
    ready = over_chunks(bars, [*stages, ind.sma_lagged_stage(averages)], DAY, step=rec.common_step(*coefs))
    ready = ind.held_ratio(ready, [f"rsi_{p}" for p in periods], DAY)
    signal = sig.rsi_trend(
        "rsi_oversold",
        "rsi_overbought",
        True,
        pick("rsi_", "rsi_period", periods),
        pick("sma_", "sma_period", averages),
    )
    return ready, signal, [*[f"rsi_{p}" for p in periods], *[f"sma_{n}" for n in averages]]


def pair_inputs(pair: DataFrame, lookbacks: Sequence[int], hedges: Sequence[float] = ()):
    """Pair bars (close_a, close_b); leg A is what is traded, the spread is what barriers look at: (bars, signal, columns, gauge).

    The hedge rolls, unless a configuration has ``use_dynamic_hedge`` false and a ``hedge_ratio``, one of ``hedges``.
    """
    stages = []
    for n in lookbacks:
        stages += ind.pair_stages(n, None, f"_dyn{n}")
        for k, h in enumerate(hedges):
            stages += ind.pair_stages(n, h, f"_fix{k}_{n}")
    ready = over_chunks(pair, stages, DAY).withColumn("close", F.col("close_a"))

    def of(name: str) -> Column:
        """The column of the configuration's own lookback and hedge."""
        out = pick(f"{name}_dyn", "zscore_lookback", lookbacks)
        for k, h in enumerate(hedges):
            own = ~F.col("use_dynamic_hedge") & (F.col("hedge_ratio") == F.lit(float(h)))
            out = F.when(own, pick(f"{name}_fix{k}_", "zscore_lookback", lookbacks)).otherwise(out)
        return out

    kinds = ["_dyn", *(f"_fix{k}_" for k in range(len(hedges)))]
    keep = [f"{name}{kind}{n}" for name in ("spread", "spread_z") for kind in kinds for n in lookbacks]
    return ready, sig.pair("entry_threshold", F.col("exit_threshold"), of("spread_z")), keep, of("spread")


def supervised_signal(rows: DataFrame, probability: Column | None = None) -> DataFrame:
    """Probability latch that starts flat every day: an order only where the state changes."""
    w = W.partitionBy(*_GROUP).orderBy("bar")
    p = F.col("probability") if probability is None else probability
    want = F.when(p >= F.col("buy_threshold"), 1).when(p <= F.col("sell_threshold"), 0)
    held = rows.withColumn(
        "_in", F.coalesce(F.last(want, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    )
    return held.withColumn("_sig", F.col("_in") - F.coalesce(F.lag("_in").over(w), F.lit(0))).drop("_in")


def supervised_inputs(bars: DataFrame, models: Sequence[str]):
    """Bars scored once by each model (columns ``probability_<model>``) under a grid whose ``model`` names one of them."""
    missing = [m for m in models if f"probability_{m}" not in bars.columns]
    if missing:
        raise ValueError(f"bars are not scored by: {missing}")
    p = pick("probability_", "model", models)
    return bars, lambda rows: supervised_signal(rows, p), [f"probability_{m}" for m in models]


def best_configs(results: DataFrame, metric: str = "sharpe_ratio", by: Sequence[str] = ("symbol",)) -> DataFrame:
    return best_rows(results, metric, by)


def rerun_best(results: DataFrame, metric: str, bars: DataFrame, daily: DataFrame, grid: ParamGrid, *args, **kwargs) -> DataFrame:
    """Daily rows of the best configuration of every symbol in ``results``; only those configurations are run again.

    Further arguments are those of ``sweep_days``.
    """
    best = best_configs(results, metric).select("symbol", "config_id")
    return sweep_days(bars, daily, grid, *args, only=best, **kwargs)
