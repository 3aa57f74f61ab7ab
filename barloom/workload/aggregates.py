"""Resampling, metrics and group aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.numeric import ratio
from barloom.operators import joins, resample
from barloom.operators import metrics as m
from barloom.workload import fixtures as fx
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import BAR, DAY, out, r6

OHLCV = ("open", "high", "low", "close", "volume")


def _with_returns(daily):
    w = W.partitionBy("symbol").orderBy("day")
    return daily.withColumn("ret", ratio("close", F.lag("close").over(w)) - 1)


def daily_returns(spark, sf):
    return _with_returns(fx.daily(spark, sf))


def long_returns(spark, sf):
    return _with_returns(fx.daily_long(spark, sf))


def aligned(spark, sf):
    """Every series against the series ``view``."""
    days = daily_returns(spark, sf)
    bench = days.where(F.col("symbol") == "view").select("day", F.col("ret").alias("ret_ticker"))
    every = days.select("symbol", "day").join(bench, "day")
    return joins.align_returns(days, every)


def measured(spark, sf):
    """Daily returns with the risk-free rate, equity and drawdown."""
    days = joins.asof_risk_free(daily_returns(spark, sf), fx.risk_free(spark, sf))
    return m.with_drawdown(m.with_equity(days, ["symbol"]), ["symbol"])


_MEASURED = """
    eq AS (SELECT d.*, f.rf_daily, d.ret - f.rf_daily AS ex,
                  product(1 + coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY d.day
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity
           FROM daily_ret d JOIN rf_daily f ON d.day = f.day),
    m AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY day
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM eq),
    dd AS (SELECT *, (equity - peak) / peak AS drawdown FROM m)"""


def _metric_sql(body: str) -> str:
    return sql("daily_ret rf_daily", f"WITH {_MEASURED} SELECT symbol, {body} FROM dd GROUP BY symbol")


def _by_symbol(df, **cols):
    doubles = df.groupBy("symbol").agg(*[c.alias(n) for n, c in cols.items()])
    return out(doubles, ["symbol"], *cols)


_BAR_SQL = """
    SELECT symbol, time_bucket(INTERVAL {k} MINUTE, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high,
           min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume{more}
    FROM {src} GROUP BY 1, 2"""


@query(
    "resample_intraday",
    sql(
        "ticks",
        f"""SELECT symbol, ts, CAST(ts AS DATE) AS day, open, high, low, close, volume,
               CAST(hour(ts) * 60 + minute(ts) - 569 AS INTEGER) AS min_from_open
            FROM ({_BAR_SQL.format(k=15, src='ticks', more='')})""",
    ),
)
def resample_intraday(spark, sf):
    return resample.resample_intraday(fx.ticks(spark, sf), 15).select(*BAR, "day", *OHLCV, "min_from_open")


@query(
    "resample_custom_aggs",
    sql(
        "ticks",
        f"""SELECT symbol, ts, close, n_ticks, round(avg_close, 6) AS avg_close FROM ({_BAR_SQL.format(
            k=30, src='ticks', more=', count(*) AS n_ticks, avg(close) AS avg_close')})""",
    ),
)
def resample_custom_aggs(spark, sf):
    extra = {"n_ticks": F.count(F.lit(1)), "avg_close": F.avg("close")}
    return out(resample.resample_intraday(fx.ticks(spark, sf), 30, extra), BAR, "close", "n_ticks", "avg_close")


@query(
    "resample_training",
    sql(
        "bars_5m",
        f"""
        WITH v AS (
            SELECT *, sum(volume * (high + low + close) / 3) OVER w / nullif(sum(volume) OVER w, 0) AS vwap
            FROM bars_5m WINDOW w AS (PARTITION BY symbol, day ORDER BY ts))
        SELECT symbol, ts, close, volume, round(vwap, 6) AS vwap
        FROM ({_BAR_SQL.format(k=60, src='v', more=', avg(vwap) AS vwap')}) WHERE vwap IS NOT NULL""",
    ),
)
def resample_training(spark, sf):
    from barloom.operators.intraday import vwap

    return out(resample.resample_training(vwap(fx.bars(spark, sf, 5)), 60), BAR, "close", "volume", "vwap")


@query(
    "resample_daily",
    sql(
        "daily_long",
        """
        SELECT 'week' AS kind, symbol, CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS period,
               arg_min(open, day) AS open, max(high) AS high, min(low) AS low, arg_max(close, day) AS close,
               sum(volume) AS volume FROM daily_long GROUP BY 1, 2, 3
        UNION ALL
        SELECT 'month', symbol, last_day(day), arg_min(open, day), max(high), min(low), arg_max(close, day),
               sum(volume) FROM daily_long GROUP BY 1, 2, 3""",
    ),
)
def resample_daily(spark, sf):
    days = fx.daily_long(spark, sf)
    parts = [
        resample.resample_daily(days, p).select(F.lit(p).alias("kind"), "symbol", "period", *OHLCV)
        for p in ("week", "month")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "daily_from_intraday",
    sql("daily", "SELECT symbol, day, open, high, low, close, volume, n_bars FROM daily"),
)
def daily_from_intraday(spark, sf):
    return fx.daily(spark, sf).select(*DAY, *OHLCV, "n_bars")


@query("total_return", _metric_sql("round(product(1 + ret) - 1, 6) AS total_return"))
def total_return(spark, sf):
    return _by_symbol(daily_returns(spark, sf), total_return=m.total_return(F.col("ret")))


@query(
    "annualized_return",
    _metric_sql("round(pow(product(1 + ret), 252.0 / count(ret)) - 1, 6) AS annualized_return"),
)
def annualized_return(spark, sf):
    return _by_symbol(daily_returns(spark, sf), annualized_return=m.annualized_return(F.col("ret")))


@query(
    "volatility",
    _metric_sql(
        "round(stddev_samp(ret), 6) AS vol, round(stddev_pop(ret), 6) AS vol_pop, "
        "round(stddev_samp(ret) * sqrt(252), 6) AS vol_annual"
    ),
)
def volatility(spark, sf):
    r = F.col("ret")
    return _by_symbol(
        daily_returns(spark, sf),
        vol=m.volatility(r),
        vol_pop=m.volatility(r, population=True),
        vol_annual=m.volatility(r, annualize=True),
    )


_VAR = """
    WITH s AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) - 1 AS i,
                      count(*) OVER (PARTITION BY symbol) AS n FROM {src} WHERE ret IS NOT NULL)
    SELECT symbol,
           round(max(CASE WHEN i = CAST(floor((1::DOUBLE - 0.95::DOUBLE) * n) AS BIGINT) THEN -ret END), 6) AS var_95,
           round(max(CASE WHEN i = CAST(floor((1::DOUBLE - 0.99::DOUBLE) * n) AS BIGINT) THEN -ret END), 6) AS var_99
    FROM s GROUP BY symbol"""


@query("var_historical", sql("long_ret", _VAR.format(src="long_ret")))
def var_historical(spark, sf):
    r = F.col("ret")
    return _by_symbol(long_returns(spark, sf), var_95=m.value_at_risk(r), var_99=m.value_at_risk(r, 0.99))


_SHARPE = "CASE WHEN count({x}) >= 20 THEN CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) * sqrt(252) ELSE 0 END END"
_SORTINO = "CASE WHEN count({x}) >= 20 THEN avg({x}) / nullif(sqrt(avg(CASE WHEN {x} < 0 THEN {x} * {x} END)), 0) * sqrt(252) END"


@query("sharpe", _metric_sql(f"round({_SHARPE.format(x='ex')}, 6) AS sharpe_ratio"))
def sharpe(spark, sf):
    return _by_symbol(measured(spark, sf), sharpe_ratio=m.sharpe(m.excess()))


@query("sortino", _metric_sql(f"round({_SORTINO.format(x='ex')}, 6) AS sortino_ratio"))
def sortino(spark, sf):
    return _by_symbol(measured(spark, sf), sortino_ratio=m.sortino(m.excess()))


@query("max_drawdown", _metric_sql("round(min(drawdown), 6) AS max_drawdown"))
def max_drawdown(spark, sf):
    days = m.with_equity(daily_returns(spark, sf), ["symbol"])
    return out(m.max_drawdown(days, ["symbol"]), ["symbol"], "max_drawdown")


_CALMAR = "(pow(product(1 + {r}), 252.0 / count({r})) - 1) / nullif(abs(min({d})), 0)"


@query("calmar", _metric_sql(f"round({_CALMAR.format(r='ret', d='drawdown')}, 6) AS calmar_ratio"))
def calmar(spark, sf):
    return _by_symbol(measured(spark, sf), calmar_ratio=m.calmar(F.col("ret"), F.col("drawdown")))


@query("win_rate", _metric_sql("round(coalesce(avg(CASE WHEN ret IS NOT NULL THEN (ret > 0)::INTEGER END), 0), 6) AS win_rate"))
def win_rate(spark, sf):
    return _by_symbol(daily_returns(spark, sf), win_rate=m.win_rate(F.col("ret")))


_IDX = "list_sort(list(ret) FILTER (WHERE ret IS NOT NULL))[CAST(floor((1::DOUBLE - {c}::DOUBLE) * count(ret)) AS BIGINT) + 1]"


@query(
    "metrics_all",
    _metric_sql(
        f"""round(product(1 + ret) - 1, 6) AS total_return,
        round(pow(product(1 + ret), 252.0 / count(ret)) - 1, 6) AS annualized_return,
        round(stddev_samp(ret) * sqrt(252), 6) AS annualized_volatility,
        round({_SHARPE.format(x='ex')}, 6) AS sharpe_ratio, round({_SORTINO.format(x='ex')}, 6) AS sortino_ratio,
        round({_CALMAR.format(r='ret', d='drawdown')}, 6) AS calmar_ratio, round(min(drawdown), 6) AS max_drawdown,
        round(avg(CASE WHEN ret IS NOT NULL THEN (ret > 0)::INTEGER END), 6) AS win_rate,
        round(-{_IDX.format(c=0.95)}, 6) AS var_95, round(-{_IDX.format(c=0.99)}, 6) AS var_99"""
    ),
)
def metrics_all(spark, sf):
    done = m.metrics_all(measured(spark, sf).drop("drawdown"), ["symbol"])
    return out(done, ["symbol"], *[c for c in done.columns if c != "symbol"])


_ALIGNED = """
    al AS (SELECT a.symbol, a.ret AS r, b.ret AS b FROM daily_ret a JOIN daily_ret b
           ON a.day = b.day AND b.symbol = 'view' WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)"""
_BETA = "covar_samp(r, b) / nullif(var_samp(b), 0)"
_CORR = "covar_samp(r, b) / nullif(stddev_samp(r) * stddev_samp(b), 0)"
_BENCH = {
    "beta": _BETA,
    "alpha": f"((avg(r) - 0.05::DOUBLE / 252) - {_BETA} * (avg(b) - 0.05::DOUBLE / 252)) * 252",
    "correlation": _CORR,
    "r_squared": f"pow({_CORR}, 2)",
    "information_ratio": "252 * avg(r - b) / nullif(stddev_samp(r - b) * sqrt(252), 0)",
    "treynor_ratio": f"(252 * avg(r) - 0.05::DOUBLE) / nullif({_BETA}, 0)",
}


def _bench_sql(*names: str) -> str:
    cols = ", ".join(f"round({_BENCH[n]}, 6) AS {n}" for n in names)
    return sql("daily_ret", f"WITH {_ALIGNED} SELECT symbol, {cols} FROM al GROUP BY symbol")


def _bench(name, *metrics):
    @query(name, _bench_sql(*metrics))
    def run(spark, sf):
        cols = m.benchmark_metrics(F.col("ret"), F.col("ret_ticker"), 0.05)
        return _by_symbol(aligned(spark, sf), **{k: cols[k] for k in metrics})

    return run


_bench("beta_alpha", "beta", "alpha")
_bench("correlation_r_squared", "correlation", "r_squared")
_bench("information_ratio", "information_ratio")
_bench("treynor", "treynor_ratio")


@query("benchmark_all", _bench_sql(*_BENCH))
def benchmark_all(spark, sf):
    return out(m.benchmark_all(aligned(spark, sf), ["symbol"], 0.05), ["symbol"], *_BENCH)


REPORT_CTES = """
    rep_eq AS (SELECT *, ret - rf_daily AS ex, ret_ticker - rf_daily AS ex_t,
               product(1 + coalesce(ret, 0)) OVER w AS eq, product(1 + coalesce(ret_ticker, 0)) OVER w AS eq_t
               FROM rep_in WINDOW w AS (PARTITION BY {keys} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    rep_pk AS (SELECT *, max(eq) OVER w AS pk, max(eq_t) OVER w AS pk_t
               FROM rep_eq WINDOW w AS (PARTITION BY {keys} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    rep_dd AS (SELECT *, (eq - pk) / pk AS dd, (eq_t - pk_t) / pk_t AS dd_t,
               CASE WHEN ret_ticker IS NOT NULL THEN ret END AS r, CASE WHEN ret IS NOT NULL THEN ret_ticker END AS b FROM rep_pk)"""
REPORT_COLUMNS = {
    "n_days": "count(ret)",
    "total_return_pct": "round((product(1 + ret) - 1) * 100, 2)",
    "annualized_return_pct": "round((pow(product(1 + ret), 252.0 / nullif(count(ret), 0)) - 1) * 100, 2)",
    "win_rate_pct": "round(coalesce(avg(CASE WHEN ret IS NOT NULL THEN (ret > 0)::INTEGER END), 0) * 100, 2)",
    "max_drawdown_pct": "round(min(dd) * 100, 2)",
    "annualized_volatility_pct": "round(stddev_samp(ret) * sqrt(252) * 100, 2)",
    "sharpe_ratio": f"round({_SHARPE.format(x='ex')}, 4)",
    "sortino_ratio": f"round({_SORTINO.format(x='ex')}, 4)",
    "calmar_ratio": f"round({_CALMAR.format(r='ret', d='dd')}, 4)",
    "hold_return_pct": "round((product(1 + ret_ticker) - 1) * 100, 2)",
    "hold_annualized_return_pct": "round((pow(product(1 + ret_ticker), 252.0 / nullif(count(ret_ticker), 0)) - 1) * 100, 2)",
    "hold_max_drawdown_pct": "round(min(dd_t) * 100, 2)",
    "hold_volatility_pct": "round(stddev_samp(ret_ticker) * sqrt(252) * 100, 2)",
    "hold_sharpe_ratio": f"round({_SHARPE.format(x='ex_t')}, 4)",
    "hold_sortino_ratio": f"round({_SORTINO.format(x='ex_t')}, 4)",
    "hold_calmar_ratio": f"round({_CALMAR.format(r='ret_ticker', d='dd_t')}, 4)",
    "beta": f"round({_BETA}, 4)",
    "alpha_pct": f"round(((avg(r) - {{rf}}::DOUBLE / 252) - {_BETA} * (avg(b) - {{rf}}::DOUBLE / 252)) * 252 * 100, 4)",
    "correlation": f"round({_CORR}, 4)",
    "r_squared": f"round(pow({_CORR}, 2), 4)",
    "information_ratio": "round(252 * avg(r - b) / nullif(stddev_samp(r - b) * sqrt(252), 0), 4)",
    "treynor_ratio": f"round((252 * avg(r) - {{rf}}::DOUBLE) / nullif({_BETA}, 0), 4)",
}


def report_select(rf: float = 0.0, skip: tuple[str, ...] = ()) -> str:
    zero = {n: "" if n == "n_days" else " + 0" for n in REPORT_COLUMNS}
    return ", ".join(f"{c.format(rf=rf)}{zero[n]} AS {n}" for n, c in REPORT_COLUMNS.items() if n not in skip)


_REPORT = f"""WITH rep_in AS (
    SELECT a.symbol, a.day, a.ret * 0.005 AS ret, b.ret * 0.005 AS ret_ticker, f.rf_daily FROM daily_ret a
    JOIN daily_ret b ON a.day = b.day AND b.symbol = 'view' JOIN rf_daily f ON a.day = f.day),
    {REPORT_CTES.format(keys='symbol')}"""


def report_days(spark, sf):
    """Half a percent of the capital invested: the raw series moves by whole multiples a day."""
    days = joins.asof_risk_free(daily_returns(spark, sf), fx.risk_free(spark, sf))
    days = days.withColumn("ret", F.col("ret") * 0.005)
    bench = days.where(F.col("symbol") == "view").select("day", F.col("ret").alias("ret_ticker"))
    return days.join(bench, "day")


@query(
    "strategy_report",
    sql("daily_ret rf_daily", f"{_REPORT} SELECT symbol, {report_select(0.05)} FROM rep_dd GROUP BY symbol"),
)
def strategy_report(spark, sf):
    return m.strategy_report(report_days(spark, sf), ["symbol"], 0.05)


@query(
    "excess_vs_benchmark",
    sql(
        "daily_ret rf_daily",
        f"""{_REPORT}, t AS (SELECT symbol, {report_select(0.05)} FROM rep_dd GROUP BY symbol)
        SELECT symbol, round(total_return_pct - hold_return_pct, 4) AS excess_return_pct FROM t""",
    ),
)
def excess_vs_benchmark(spark, sf):
    done = m.excess_vs_hold(m.strategy_report(report_days(spark, sf), ["symbol"], 0.05))
    return out(done, ["symbol"], "excess_return_pct", digits=4)


def _rows_by_month(spark, sf):
    """A table with the shape of sweep results: the metric of every (symbol, month)."""
    return (
        long_returns(spark, sf)
        .groupBy("symbol", (F.year("day") * 100 + F.month("day")).alias("config_id"))
        .agg(m.sharpe(F.col("ret")).alias("sharpe_ratio"), (m.total_return(F.col("ret")) * 100).alias("total_return_pct"))
    )


_MONTHS = f"""WITH mon AS (
    SELECT symbol, CAST(year(day) * 100 + month(day) AS INTEGER) AS config_id,
           {_SHARPE.format(x='ret')} AS sharpe_ratio, (product(1 + ret) - 1) * 100 AS total_return_pct
    FROM long_ret GROUP BY 1, 2)"""


@query(
    "best_by_symbol",
    sql(
        "long_ret",
        f"""{_MONTHS} SELECT symbol, config_id, round(sharpe_ratio, 6) AS sharpe_ratio FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe_ratio DESC NULLS LAST, config_id) AS r
            FROM mon) WHERE r = 1""",
    ),
)
def best_by_symbol(spark, sf):
    best = m.best_rows(_rows_by_month(spark, sf), "sharpe_ratio", ["symbol"])
    return out(best, ("symbol", "config_id"), "sharpe_ratio")


@query(
    "best_by_pair",
    sql(
        "long_ret",
        f"""{_MONTHS} SELECT symbol, yr, config_id, round(total_return_pct, 4) AS total_return_pct FROM (
            SELECT *, CAST(config_id // 100 AS INTEGER) AS yr, row_number() OVER (
                PARTITION BY symbol, config_id // 100 ORDER BY total_return_pct NULLS LAST, config_id) AS r
            FROM mon) WHERE r = 1""",
    ),
)
def best_by_pair(spark, sf):
    """Lowest return per (symbol, year): a two-column group and an ascending metric."""
    rows = _rows_by_month(spark, sf).withColumn("yr", F.floor(F.col("config_id") / 100).cast("int"))
    best = m.best_rows(rows, "total_return_pct", ["symbol", "yr"], ascending=True)
    return out(best, ("symbol", "yr", "config_id"), "total_return_pct", digits=4)


@query(
    "sweep_summary",
    sql(
        "long_ret",
        f"""{_MONTHS} SELECT symbol, count(*) AS n_configs, round(min(sharpe_ratio), 6) AS min_sharpe,
            round(max(sharpe_ratio), 6) AS max_sharpe, round(min(total_return_pct), 4) AS min_return_pct,
            round(max(total_return_pct), 4) AS max_return_pct FROM mon GROUP BY symbol""",
    ),
)
def sweep_summary(spark, sf):
    done = m.sweep_summary(_rows_by_month(spark, sf))
    return done.select(
        "symbol",
        "n_configs",
        F.round("min_sharpe", 6).alias("min_sharpe"),
        F.round("max_sharpe", 6).alias("max_sharpe"),
        F.round("min_return_pct", 4).alias("min_return_pct"),
        F.round("max_return_pct", 4).alias("max_return_pct"),
    )
