"""Parameter sweeps of the six strategies, their summaries and grids.

The SQL side lays all configurations over all bars and walks every (configuration, symbol) with
global windows; it knows nothing of the day-by-day reduction it checks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import intraday, joins
from barloom.operators import metrics as m
from barloom.operators.joins import join_pair
from barloom.functions.bars import bar_minute
from barloom.plans import sweep as sw
from barloom.plans.grids import ParamGrid, default_config, grid_sizes
from barloom.session import materialize
from barloom.sources import calendar
from barloom.workload import fixtures as fx
from barloom.workload.aggregates import REPORT_COLUMNS, REPORT_CTES, report_select
from barloom.workload.fixtures import query, sql
from barloom.workload.positions import barrier_ctes, latch_ctes, run_ctes
from barloom.workload.signals import MOM_CTES, decide, momentum_bars
from barloom.workload.windows import VWAP_SQL, WD, full, rsi_wilder_ctes, walk, z_lagged, TR_SQL

COST = 0.0005
WARMUP_VOL = 0.01


def priced_days(spark, sf):
    """Daily bars with their volatility; before it is known, a flat prior."""
    vol = intraday.daily_vol(fx.daily(spark, sf, True))
    return vol.withColumn("ticker_dvol", F.coalesce("ticker_dvol", F.lit(WARMUP_VOL)))


def run(spark, sf, strategy, grid, inputs, daily=None, **how):
    """The sweep table of a strategy's inputs: bars, signal, columns and, for pairs, what barriers look at."""
    bars, signal, keep, *gauge = inputs
    daily = priced_days(spark, sf) if daily is None else daily
    how |= {"gauge": gauge[0]} if gauge else {}
    return sw.sweep(bars, daily, grid, signal, keep, COST, fx.risk_free(spark, sf), 0.05, strategy=strategy, **how)


# ------------------------------------------------------------------ SQL


def grid_cte(grid: ParamGrid) -> str:
    lit = lambda v: f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v)
    rows = ", ".join(
        f"({i}, {', '.join(lit(v) for v in combo)})" for i, combo in enumerate(itertools.product(*grid.params.values()))
    )
    return f"g AS (SELECT * FROM (VALUES {rows}) t(config_id, {', '.join(grid.params)}))"


def days_cte(label: str = "symbol", where: str = "TRUE") -> str:
    return f"""
    dy AS (SELECT {label} AS symbol, day, close, ret AS ret_ticker, lag(close) OVER w AS prev_close,
              coalesce(CASE WHEN count(ret) OVER v = 15 THEN stddev_samp(ret) OVER v END, {WARMUP_VOL}) AS vol
           FROM daily_ret WHERE {where} WINDOW w AS (PARTITION BY symbol ORDER BY day),
              v AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))"""


PART = "config_id, symbol"


PRICE_PNL = "(close - entry_price) / entry_price"


#: Tradable bars, and the close that each (symbol, day) starts from.
ALL_BARS = "kb AS (SELECT * FROM sb), hc AS (SELECT symbol, day, prev_close AS held_close FROM dy)"
CALENDAR_BARS = """kb AS (SELECT * FROM sb WHERE day <> DATE '2024-01-15' AND (day <> DATE '2024-01-10' OR min_from_open <= 13 * 60 - 570)),
    ends AS (SELECT symbol, day, arg_max(close, ts) AS e FROM kb GROUP BY 1, 2),
    hc AS (SELECT symbol, day, lag(e) OVER (PARTITION BY symbol ORDER BY day) AS held_close FROM ends)"""


def daily_ctes(
    grid: ParamGrid, signal: str, kept: str = ALL_BARS, days: str | None = None, mark: str = "close", pnl: str = PRICE_PNL
) -> str:
    """From the bars ``src`` to ``rep_in``: strategy rows per configuration, symbol and day."""
    # the strategies always run with barriers: those of the grid, or 2 and 4 percent
    stop = "stop_loss_pct" if "stop_loss_pct" in grid.params else "0.02::DOUBLE"
    gain = "take_profit_pct" if "take_profit_pct" in grid.params else "0.04::DOUBLE"
    freq = "trade_freq" if "trade_freq" in grid.params else "30"
    target = "target_vol" if "target_vol" in grid.params else "0.02::DOUBLE"
    limit = "drawdown_limit" if "drawdown_limit" in grid.params else "0.15::DOUBLE"
    held = f"{run_ctes(PART, mark)}, {barrier_ctes(stop, gain, PART, pnl)}"
    return f"""
    {days or days_cte()},
    {grid_cte(grid)},
    {kept},
    pb AS (SELECT s.*, s.close / coalesce(lag(s.close) OVER d, hc.held_close, dy.prev_close) - 1 AS chg,
               coalesce(nth_value(min_from_open, 2) OVER e - first_value(min_from_open) OVER e, 1) AS spacing
           FROM kb s JOIN dy ON s.symbol = dy.symbol AND s.day = dy.day JOIN hc ON s.symbol = hc.symbol AND s.day = hc.day
           WHERE dy.prev_close IS NOT NULL
           WINDOW d AS (PARTITION BY s.symbol, s.day ORDER BY s.ts),
               e AS (PARTITION BY s.symbol, s.day ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    gb AS (SELECT *, CAST(coalesce(greatest(1, floor({freq} / nullif(spacing, 0)::DOUBLE)), 1) AS BIGINT) AS k FROM pb, g),
    {signal},
    {latch_ctes('sg2', 'k', PART, False)}, {held},
    ur AS (SELECT config_id, symbol, day,
               product(1 + was * chg - {COST}::DOUBLE * abs(held - was)) - 1 AS unit_ret,
               CAST(sum((held = 1 AND was = 0)::INTEGER) AS BIGINT) AS buys, CAST(sum((held = 0 AND was = 1)::INTEGER) AS BIGINT) AS sells,
               CAST(sum((exit_reason = 2)::INTEGER) AS BIGINT) AS stop_losses, CAST(sum((exit_reason = 3)::INTEGER) AS BIGINT) AS take_profits
           FROM be GROUP BY 1, 2, 3),
    sz2 AS (SELECT ur.*, {'target_vol, drawdown_limit, ' if limit == "drawdown_limit" else ''}dy.ret_ticker, least({target} / dy.vol, 1) * unit_ret AS ret0, f.rf_daily
            FROM ur JOIN dy USING (symbol, day) JOIN rf_daily f USING (day) JOIN g USING (config_id)),
    q1 AS (SELECT *, product(1 + ret0) OVER (PARTITION BY {PART} ORDER BY day ROWS UNBOUNDED PRECEDING) AS eq0 FROM sz2),
    q2 AS (SELECT *, coalesce(lag(eq0) OVER (PARTITION BY {PART} ORDER BY day), 1) AS prior FROM q1),
    q3 AS (SELECT *, greatest(max(prior) OVER (PARTITION BY {PART} ORDER BY day ROWS UNBOUNDED PRECEDING), 1) AS peak0 FROM q2),
    q4 AS (SELECT *, min(CASE WHEN abs((prior - peak0) / peak0) > {limit} THEN day END) OVER (PARTITION BY {PART}) AS stop_day FROM q3),
    rep_in AS (SELECT config_id, symbol, day, ret_ticker, rf_daily, CASE WHEN day > stop_day THEN 0 ELSE ret0 END AS ret,
               CASE WHEN day > stop_day OR (day = stop_day AND ret0 = 0) THEN 0 ELSE buys END AS buys,
               CASE WHEN day > stop_day OR (day = stop_day AND ret0 = 0) THEN 0 ELSE sells END AS sells,
               CASE WHEN day > stop_day OR (day = stop_day AND ret0 = 0) THEN 0 ELSE stop_losses END AS stop_losses,
               CASE WHEN day > stop_day OR (day = stop_day AND ret0 = 0) THEN 0 ELSE take_profits END AS take_profits FROM q4)"""


def sweep_ctes(grid: ParamGrid, ctes: str, signal: str, days: str | None = None, **how) -> str:
    params = ", ".join(f"any_value(g.{p}) AS {p}" for p in grid.params)
    trades = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("buys", "sells", "stop_losses", "take_profits"))
    return f"""{ctes}, {daily_ctes(grid, signal, days=days, **how)}, {REPORT_CTES.format(keys=PART)},
    st AS (SELECT r.config_id, r.symbol, {report_select(0.05)}, {trades}, {params}
           FROM rep_dd r JOIN g ON r.config_id = g.config_id GROUP BY 1, 2)"""


def sweep_sql(uses: str, grid: ParamGrid, ctes: str, signal: str, days=None, tail="SELECT * FROM st", **how) -> str:
    body = f"WITH {sweep_ctes(grid, ctes, signal, days, **how)} {tail}"
    return sql(f"{uses} daily_ret rf_daily", body, recursive=True, calm=True)


def signed(long: str, leave: str) -> str:
    return f"sg2 AS (SELECT *, {decide(long, leave)} FROM gb)"


# ------------------------------------------------------------------ the six strategies

GRID_MR = ParamGrid(
    {
        "zscore_lookback": [5, 10],
        "n_std_upper": [1.0, 1.5],
        "n_std_lower": [0.8, 1.2],
        "exit_threshold": [0.0, 0.5],
        "trade_freq": [5, 30],
        "stop_loss_pct": [0.003],
        "take_profit_pct": [0.006],
        "target_vol": [0.002],
        "drawdown_limit": [0.01],
    }
)
_Z_SWEEP = "CASE zscore_lookback WHEN 5 THEN z5 ELSE z10 END"
MR = (
    "bars_5m",
    GRID_MR,
    f"sb AS (SELECT *, {z_lagged(5, part=WD)} AS z5, {z_lagged(10, part=WD)} AS z10 FROM bars_5m)",
    f"""sg2 AS (SELECT *, {decide('z < -n_std_lower', 'z > n_std_upper OR (z >= exit_threshold AND z <= n_std_upper)')}
        FROM (SELECT *, {_Z_SWEEP} AS z FROM gb))""",
)


def reversion_sweep_inputs(spark, sf, grid=GRID_MR, minutes=5):
    return sw.mean_reversion_inputs(fx.bars(spark, sf, minutes, True), grid.params["zscore_lookback"])


@query("sweep_mean_reversion", sweep_sql(*MR))
def sweep_mean_reversion(spark, sf):
    return run(spark, sf, "mean_reversion", GRID_MR, reversion_sweep_inputs(spark, sf))


@query("sweep_mean_reversion_buckets", sweep_sql(*MR))
def sweep_mean_reversion_buckets(spark, sf):
    """The same grid in buckets of five configurations."""
    return run(spark, sf, "mean_reversion", GRID_MR, reversion_sweep_inputs(spark, sf), size=5)


@query("sweep_with_calendar", sweep_sql(*MR, kept=CALENDAR_BARS))
def sweep_with_calendar(spark, sf):
    """The same grid where one day is closed and another one ends early."""
    closed = calendar.sessions(fx.holidays(spark, sf), fx.early_closes(spark, sf))
    return run(spark, sf, "mean_reversion", GRID_MR, reversion_sweep_inputs(spark, sf), sessions=closed)


GRID_MOM = ParamGrid({"band_mult": [0.5, 1.0], "trade_freq": [60, 120]})


@query(
    "sweep_momentum",
    sweep_sql(
        "bars_1h daily dividends",
        GRID_MOM,
        f"{MOM_CTES}, sb AS (SELECT * FROM mm WHERE known > 0)",
        signed(
            "close > hi * (1 + band_mult * sigma_open) AND close > vwap",
            "coalesce(close < lo * (1 - band_mult * sigma_open), FALSE) OR coalesce(close < vwap, FALSE)",
        ),
    ),
)
def sweep_momentum(spark, sf):
    bars, day = momentum_bars(spark, sf, True)
    vols = priced_days(spark, sf).select("symbol", "day", "ticker_dvol")
    return run(spark, sf, "momentum", GRID_MOM, sw.momentum_inputs(bars), daily=day.join(vols, ["symbol", "day"], "left"))


GRID_ATR = ParamGrid(
    {
        "atr_mult": [1.0, 2.0],
        "atr_period": [5, 10],
        "trade_freq": [5, 20],
        "stop_loss_pct": [0.002, 0.004],
        "take_profit_pct": [0.01],
    }
)
_ATR = ", ".join(
    walk("tr", "symbol, day", "true_range", p, f"({p - 1}.0::DOUBLE / {p})", 0, f"av{p}") for p in (5, 10)
)


@query(
    "sweep_momentum_atr",
    sweep_sql(
        "bars_5m",
        GRID_ATR,
        f"""tr AS MATERIALIZED ({TR_SQL.format(src='bars_5m')}), {_ATR},
        sb AS (SELECT b.*, av5.y AS a5, av10.y AS a10, max(high) OVER w AS hi, min(low) OVER w AS lo, {VWAP_SQL.replace('PARTITION BY symbol, day ORDER BY ts', 'PARTITION BY b.symbol, b.day ORDER BY b.ts')} AS vwap
               FROM bars_5m b LEFT JOIN av5 ON b.symbol = av5.symbol AND b.ts = av5.ts LEFT JOIN av10 ON b.symbol = av10.symbol AND b.ts = av10.ts
               WINDOW w AS (PARTITION BY b.symbol, b.day ORDER BY b.ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))""",
        f"""sg1 AS (SELECT *, hi + atr_mult * CASE atr_period WHEN 5 THEN a5 ELSE a10 END * 0.1::DOUBLE AS up,
               lo - atr_mult * CASE atr_period WHEN 5 THEN a5 ELSE a10 END * 0.1::DOUBLE AS dn FROM gb),
        sg2 AS (SELECT *, {decide('up IS NOT NULL AND dn IS NOT NULL AND close > up AND close > vwap',
            'up IS NOT NULL AND dn IS NOT NULL AND (coalesce(close < dn, FALSE) OR coalesce(close < vwap, FALSE))')} FROM sg1)""",
    ),
)
def sweep_momentum_atr(spark, sf):
    bars = intraday.vwap(fx.bars(spark, sf, 5, True))
    return run(spark, sf, "momentum_atr", GRID_ATR, sw.momentum_atr_inputs(bars, GRID_ATR.params["atr_period"]))


GRID_RSI = ParamGrid(
    {
        "rsi_period": [5, 7],
        "rsi_oversold": [40.0, 48.0],
        "rsi_overbought": [60.0],
        "sma_period": [10, 15],
        "trade_freq": [5],
        "stop_loss_pct": [0.003],
        "take_profit_pct": [0.006],
    }
)


@query(
    "sweep_mean_reversion_rsi",
    sweep_sql(
        "bars_5m",
        GRID_RSI,
        f"""{rsi_wilder_ctes('bars_5m', 'symbol, day', 5, '5')}, {rsi_wilder_ctes('bars_5m', 'symbol, day', 7, '7')},
        sb AS (SELECT b.*, rw5.rsi AS r5, rw7.rsi AS r7,
                   {full('avg', 'close', 10, 1, 'PARTITION BY b.symbol, b.day ORDER BY b.ts')} AS s10,
                   {full('avg', 'close', 15, 1, 'PARTITION BY b.symbol, b.day ORDER BY b.ts')} AS s15
               FROM bars_5m b LEFT JOIN rw5 ON b.symbol = rw5.symbol AND b.ts = rw5.ts LEFT JOIN rw7 ON b.symbol = rw7.symbol AND b.ts = rw7.ts)""",
        f"""sg1 AS (SELECT *, CASE rsi_period WHEN 5 THEN r5 ELSE r7 END AS r, CASE sma_period WHEN 10 THEN s10 ELSE s15 END AS s FROM gb),
        sg2 AS (SELECT *, {decide('r < rsi_oversold AND close > s', 'coalesce(r > rsi_overbought, FALSE) OR coalesce(close < s, FALSE)')} FROM sg1)""",
    ),
)
def sweep_mean_reversion_rsi(spark, sf):
    bars = fx.bars(spark, sf, 5, True)
    inputs = sw.rsi_inputs(bars, GRID_RSI.params["rsi_period"], GRID_RSI.params["sma_period"])
    return run(spark, sf, "mean_reversion_rsi", GRID_RSI, inputs)


GRID_PAIR = ParamGrid(
    {
        "zscore_lookback": [6, 9],
        "entry_threshold": [0.8, 1.2],
        "exit_threshold": [0.0, 0.4],
        "use_dynamic_hedge": [True, False],
        "hedge_ratio": [1.0, 0.9],
        "trade_freq": [5],
        "stop_loss_pct": [0.4],
        "take_profit_pct": [0.8],
    }
)


PAIR_HEDGES = [("one", 1.0), ("less", 0.9)]
_PAIR_KINDS = ["dyn", *(name for name, _ in PAIR_HEDGES)]


def _own(prefix: str) -> str:
    """The column of a configuration's lookback and hedge."""
    pick = lambda kind: f"CASE zscore_lookback WHEN 6 THEN {prefix}{kind}6 ELSE {prefix}{kind}9 END"
    return f"CASE WHEN use_dynamic_hedge THEN {pick('dyn')} WHEN hedge_ratio = 1 THEN {pick('one')} ELSE {pick('less')} END"


def _pair_z(n: int, kind: str) -> str:
    w = f"({WD} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    hedge = (
        f"CASE WHEN count(close_b) OVER w{n} = {n} THEN CASE WHEN avg(close_b) OVER w{n} > 0 THEN avg(close_a) OVER w{n} / avg(close_b) OVER w{n} ELSE 1 END END"
        if kind == "dyn"
        else f"{dict(PAIR_HEDGES)[kind]}::DOUBLE"
    )
    return f"close_a - ({hedge}) * close_b AS s{kind}{n}"


@query(
    "sweep_stat_arb",
    sweep_sql(
        "bars_5m",
        GRID_PAIR,
        f"""pa AS (SELECT 'click/view' AS symbol, a.ts, a.day, a.min_from_open, a.close AS close_a, b.close AS close_b, a.close
            FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts) AS n FROM bars_5m WHERE symbol = 'click') a
            JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts) AS n FROM bars_5m WHERE symbol = 'view') b
            ON a.day = b.day AND a.n = b.n),
        ps AS (SELECT *, {', '.join(_pair_z(n, k) for n in (6, 9) for k in _PAIR_KINDS)} FROM pa
            WINDOW w6 AS ({WD} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), w9 AS ({WD} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)),
        sb AS (SELECT *, {', '.join(f"{z_lagged(n, f's{k}{n}', WD)} AS z{k}{n}" for n in (6, 9) for k in _PAIR_KINDS)} FROM ps)""",
        f"""sg1 AS (SELECT *, {_own('z')} AS z, {_own('s')} AS own_spread FROM gb),
        sg2 AS (SELECT *, {decide('z < -entry_threshold', 'z > entry_threshold OR (z >= exit_threshold AND z <= entry_threshold)')} FROM sg1)""",
        days=days_cte("'click/view'", "symbol = 'click'"),
        mark="own_spread",
        pnl="(own_spread - entry_price) / nullif(abs(entry_price), 0)",
    ),
)
def sweep_stat_arb(spark, sf):
    pair = join_pair(fx.bars(spark, sf, 5, True), "click", "view")
    leg = priced_days(spark, sf).where(F.col("symbol") == "click").withColumn("symbol", F.lit("click/view"))
    inputs = sw.pair_inputs(pair, GRID_PAIR.params["zscore_lookback"], GRID_PAIR.params["hedge_ratio"])
    return run(spark, sf, "stat_arb", GRID_PAIR, inputs, daily=leg)


GRID_ML = ParamGrid({"buy_threshold": [0.55, 0.8], "sell_threshold": [0.2, 0.45], "trade_freq": [30, 60]})


@query(
    "sweep_supervised",
    sweep_sql(
        "scored",
        GRID_ML,
        "sb AS (SELECT *, CAST(hour(ts) * 60 + minute(ts) - 569 AS INTEGER) AS min_from_open FROM scored)",
        """sg0 AS (SELECT *, CASE WHEN probability >= buy_threshold THEN 1 WHEN probability <= sell_threshold THEN 0 END AS want FROM gb),
        sg1 AS (SELECT *, coalesce(last_value(want IGNORE NULLS) OVER (PARTITION BY config_id, symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS st FROM sg0),
        sg2 AS (SELECT *, st - coalesce(lag(st) OVER (PARTITION BY config_id, symbol, day ORDER BY ts), 0) AS signal FROM sg1)""",
    ),
)
def sweep_supervised(spark, sf):
    ticks = fx.scored_ticks(spark, sf, True).withColumn("min_from_open", bar_minute())
    return run(spark, sf, "supervised", GRID_ML, (ticks, sw.supervised_signal, ["probability"]))


GRID_MODELS = ParamGrid({"model": ["slow", "fast"], "buy_threshold": [0.55, 0.8], "sell_threshold": [0.2, 0.45], "trade_freq": [30]})


@query(
    "sweep_supervised_models",
    sweep_sql(
        "scored",
        GRID_MODELS,
        """sb AS (SELECT *, CAST(hour(ts) * 60 + minute(ts) - 569 AS INTEGER) AS min_from_open, probability AS slow,
               ((event_id * 104729) % 997) / 997.0::DOUBLE AS fast FROM scored)""",
        """sg0 AS (SELECT *, CASE model WHEN 'slow' THEN slow ELSE fast END AS p FROM gb),
        sg1 AS (SELECT *, CASE WHEN p >= buy_threshold THEN 1 WHEN p <= sell_threshold THEN 0 END AS want FROM sg0),
        sg3 AS (SELECT *, coalesce(last_value(want IGNORE NULLS) OVER (PARTITION BY config_id, symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS st FROM sg1),
        sg2 AS (SELECT *, st - coalesce(lag(st) OVER (PARTITION BY config_id, symbol, day ORDER BY ts), 0) AS signal FROM sg3)""",
    ),
)
def sweep_supervised_models(spark, sf):
    """Two models' scores of every bar, the model being one more parameter."""
    fast = ((F.col("event_id") * 104729) % 997) / F.lit(997.0)
    ticks = fx.scored_ticks(spark, sf, True).withColumn("min_from_open", bar_minute())
    scored = ticks.withColumnRenamed("probability", "probability_slow").withColumn("probability_fast", fast)
    return run(spark, sf, "supervised", GRID_MODELS, sw.supervised_inputs(scored, GRID_MODELS.params["model"]))


# ------------------------------------------------------------------ reports over a sweep


_BEST = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe_ratio DESC NULLS LAST, config_id) AS r FROM st"""


@query(
    "rerun_best",
    sweep_sql(
        *MR,
        tail=f"""SELECT config_id, symbol, day, round(ret, 6) + 0 AS ret, buys, sells FROM rep_in
        SEMI JOIN (SELECT config_id, symbol FROM ({_BEST}) WHERE r = 1) b USING (config_id, symbol)""",
    ),
)
def rerun_best(spark, sf):
    bars, signal, keep = reversion_sweep_inputs(spark, sf)
    inputs = materialize(bars), signal, keep
    results = materialize(run(spark, sf, "mean_reversion", GRID_MR, inputs))
    how = (priced_days(spark, sf), GRID_MR, signal, keep, COST, fx.risk_free(spark, sf))
    best = sw.rerun_best(results, "sharpe_ratio", inputs[0], *how, strategy="mean_reversion")
    return best.select("config_id", "symbol", "day", F.round("ret", 6).alias("ret"), "buys", "sells")


@query(
    "sweep_best_summary",
    sweep_sql(
        *MR,
        tail=f"""SELECT symbol, count(*) AS n_configs, min(sharpe_ratio) AS min_sharpe, max(sharpe_ratio) AS max_sharpe,
            min(total_return_pct) AS min_return_pct, max(total_return_pct) AS max_return_pct,
            max(CASE WHEN r = 1 THEN config_id END) AS best_config FROM ({_BEST}) GROUP BY symbol""",
    ),
)
def sweep_best_summary(spark, sf):
    """Range of results and the winning configuration per symbol."""
    table = materialize(run(spark, sf, "mean_reversion", GRID_MR, reversion_sweep_inputs(spark, sf)))
    best = sw.best_configs(table).select("symbol", F.col("config_id").alias("best_config"))
    return m.sweep_summary(table).join(best, "symbol")


@query(
    "default_grid",
    sql(
        "ticks",
        """SELECT s.symbol, CAST(l.i * 9 + u.i * 3 + n.i AS INTEGER) AS config_id, [10, 20, 30][l.i + 1] AS zscore_lookback,
               [1.5, 2.0, 2.5][u.i + 1]::DOUBLE AS n_std_upper, [1.5, 2.0, 2.5][n.i + 1]::DOUBLE AS n_std_lower
        FROM (SELECT DISTINCT symbol FROM ticks) s, range(3) l(i), range(3) u(i), range(3) n(i)""",
    ),
)
def default_grid(spark, sf):
    """Every symbol with every default configuration."""
    from barloom.plans.grids import STRATEGY_GRIDS

    lists = {k: v for k, v in STRATEGY_GRIDS["mean_reversion"].items() if k != "exit_threshold"}
    return ParamGrid(lists).multiply(fx.ticks(spark, sf).select("symbol").distinct())


@query(
    "grid_size",
    sql(
        "ticks",
        """SELECT symbol, strategy, CAST(n AS BIGINT) AS n_configs FROM (SELECT DISTINCT symbol FROM ticks),
        (VALUES ('momentum', 4), ('momentum_atr', 12), ('mean_reversion', 54), ('mean_reversion_rsi', 54),
                ('stat_arb', 36), ('supervised', 16)) t(strategy, n)""",
    ),
)
def grid_size(spark, sf):
    """Configurations per symbol and strategy."""
    return grid_sizes(fx.ticks(spark, sf).select("symbol").distinct())
