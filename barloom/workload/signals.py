"""Signals of the strategy families."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import signals as sig
from barloom.operators import indicators as ind
from barloom.operators import intraday, joins
from barloom.operators import positions as pos
from barloom.operators.series import BARS
from barloom.operators.series import DAY as DAY_LAYOUT
from barloom.plans.sweep import momentum_inputs
from barloom.workload import fixtures as fx
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import BAR
from barloom.workload.windows import (
    REF_CTES,
    SIGMA_CTES,
    VWAP_SQL,
    WD,
    WS,
    _refs,
    atr_ctes,
    full,
    pair_ctes,
    rsi_wilder_ctes,
    walk,
    z_lagged,
)


def decide(long: str, leave: str) -> str:
    return f"CASE WHEN coalesce({leave}, FALSE) THEN -1 WHEN coalesce({long}, FALSE) THEN 1 ELSE 0 END AS signal"


def momentum_bars(spark, sf, calm=False):
    """Hourly bars with everything the momentum family looks at."""
    derived = intraday.derived_columns(fx.bars(spark, sf, calm=calm), fx.daily(spark, sf, calm))
    paid = fx.dividends(spark, sf).groupBy("symbol", "day").agg(F.max("dividend").alias("dividend"))
    day = fx.daily(spark, sf, calm).join(paid, ["symbol", "day"], "left")
    return derived, day


MOM_CTES = f"""
    {SIGMA_CTES},
    dv AS (SELECT symbol, day, max(dividend) AS dividend FROM dividends GROUP BY 1, 2),
    pd AS (SELECT symbol, day, open AS day_open, lag(close) OVER w - lag(coalesce(dividend, 0)) OVER w AS adj
           FROM daily LEFT JOIN dv USING (symbol, day) WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    mm AS (SELECT sg.*, greatest(day_open, adj) AS hi, least(day_open, adj) AS lo,
                  count(sigma_open) OVER (PARTITION BY symbol, day) AS known
           FROM sg JOIN pd USING (symbol, day) WHERE adj IS NOT NULL)"""


@query(
    "sig_momentum",
    sql(
        "bars_1h daily dividends",
        f"""WITH {MOM_CTES} SELECT symbol, ts, {decide('close > hi * (1 + 1.2::DOUBLE * sigma_open) AND close > vwap',
            'coalesce(close < lo * (1 - 1.2::DOUBLE * sigma_open), FALSE) OR coalesce(close < vwap, FALSE)')}
        FROM mm WHERE known > 0""",
    ),
)
def sig_momentum(spark, sf):
    bars, day = momentum_bars(spark, sf)
    ready, signal, _ = momentum_inputs(bars)
    wide = joins.join_prev_day(ready, day).withColumn("band_mult", F.lit(1.2))
    return wide.select(*BAR, signal.alias("signal"))


_LONG = "up IS NOT NULL AND lo IS NOT NULL AND close > up AND close > vwap"
_EXIT = "up IS NOT NULL AND lo IS NOT NULL AND (coalesce(close < lo, FALSE) OR coalesce(close < vwap, FALSE))"


def _bands(ctes: str, upper: str, lower: str, src: str, uses: str = "bars_5m") -> str:
    return sql(
        uses,
        f"""WITH {ctes}, bd AS (SELECT b.symbol, b.ts, b.close, {upper} AS up, {lower} AS lo,
               sum(b.volume * ((b.high + b.low + b.close) / 3)) OVER d / nullif(sum(b.volume) OVER d, 0) AS vwap
            FROM {src} WINDOW d AS (PARTITION BY b.symbol, b.day ORDER BY b.ts),
            w AS (PARTITION BY b.symbol, b.day ORDER BY b.ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
        SELECT symbol, ts, {decide(_LONG, _EXIT)} FROM bd""",
        recursive=True,
    )


@query(
    "sig_momentum_atr",
    _bands(
        f"{REF_CTES}, {atr_ctes('rf', 14)}",
        "ref_high + 0.5::DOUBLE * y",
        "ref_low - 0.5::DOUBLE * y",
        "rf b LEFT JOIN av USING (symbol, ts)",
        "bars_5m daily",
    ),
)
def sig_momentum_atr(spark, sf):
    bars = ind.atr_bands(ind.atr(intraday.vwap(_refs(spark, sf))), 0.5)
    return bars.select(*BAR, sig.signal("band_breakout").alias("signal"))


@query(
    "sig_momentum_atr_trailing",
    _bands(
        atr_ctes("bars_5m", 14),
        "max(b.high) OVER w + 2 * y * 0.1::DOUBLE",
        "min(b.low) OVER w - 2 * y * 0.1::DOUBLE",
        "bars_5m b LEFT JOIN av USING (symbol, ts)",
    ),
)
def sig_momentum_atr_trailing(spark, sf):
    bars = ind.trailing_atr_bands(intraday.vwap(fx.bars(spark, sf, 5)), 2.0, 14, 14)
    return bars.select(*BAR, sig.signal("band_breakout").alias("signal"))


@query(
    "sig_keltner",
    _bands(
        f"{atr_ctes('bars_5m', 14)}, {walk('bars_5m', 'symbol, day', 'close', 20, '(19.0::DOUBLE / 21)', 0, 'em')}",
        "em.y + 0.5::DOUBLE * av.y",
        "em.y - 0.5::DOUBLE * av.y",
        "bars_5m b LEFT JOIN av USING (symbol, ts) LEFT JOIN em USING (symbol, ts)",
    ),
)
def sig_keltner(spark, sf):
    bars = ind.keltner_bands(intraday.vwap(fx.bars(spark, sf, 5)), 0.5)
    return bars.select(*BAR, sig.signal("band_breakout").alias("signal"))


@query(
    "sig_mean_reversion",
    sql(
        "bars_1h",
        f"""SELECT symbol, ts, round(z, 6) + 0 AS zscore, {decide('z < -1.2', 'z > 1.5 OR (z >= 0.5 AND z <= 1.5)')}
        FROM (SELECT *, {z_lagged(20)} AS z FROM bars_1h)""",
    ),
)
def sig_mean_reversion(spark, sf):
    bars = ind.zscore_lagged(fx.bars(spark, sf), [20]).withColumnRenamed("z_20", "zscore")
    signal = sig.signal("mean_reversion", n_upper=1.5, n_lower=1.2, exit_threshold=0.5)
    return bars.select(*BAR, F.round("zscore", 6).alias("zscore"), signal.alias("signal"))


def _rsi_bars(spark, sf, *averages: int):
    bars = ind.rsi_wilder(ind.sma_lagged(fx.bars(spark, sf), list(averages)), 10)
    return bars


def _rsi_sql(long: str, leave: str) -> str:
    return sql(
        "bars_1h",
        f"""WITH {rsi_wilder_ctes('bars_1h', 'symbol', 10)},
        ri AS (SELECT b.symbol, b.ts, b.close, rsi, {full('avg', 'close', 20, 1)} AS s20, {full('avg', 'close', 50, 1)} AS s50
               FROM bars_1h b LEFT JOIN rw USING (symbol, ts))
        SELECT symbol, ts, {decide(long, leave)} FROM ri""",
        recursive=True,
    )


@query("sig_rsi_sma", _rsi_sql("rsi < 48 AND close > s50", "coalesce(rsi > 55, FALSE) OR coalesce(close < s50 , FALSE)"))
def sig_rsi_sma(spark, sf):
    signal = sig.signal("rsi_trend", oversold=48, overbought=55, sma="sma_50")
    return _rsi_bars(spark, sf, 50).select(*BAR, signal.alias("signal"))


@query("sig_rsi_sma_no_cross", _rsi_sql("rsi < 48 AND close > s50", "rsi > 55"))
def sig_rsi_sma_no_cross(spark, sf):
    signal = sig.signal("rsi_trend", oversold=48, overbought=55, exit_on_cross=False, sma="sma_50")
    return _rsi_bars(spark, sf, 50).select(*BAR, signal.alias("signal"))


_VALID = "rsi IS NOT NULL AND s20 IS NOT NULL AND s50 IS NOT NULL"


@query(
    "sig_rsi_dual_sma",
    _rsi_sql(f"{_VALID} AND rsi < 49 AND close > s50 AND s20 > s50", f"{_VALID} AND (rsi > 55 OR close < s50)"),
)
def sig_rsi_dual_sma(spark, sf):
    signal = sig.signal("rsi_dual_trend", oversold=49, overbought=55, short="sma_20", long="sma_50")
    return _rsi_bars(spark, sf, 20, 50).select(*BAR, signal.alias("signal"))


@query("sig_rsi_contrarian", _rsi_sql("rsi < 45", "rsi > 55"))
def sig_rsi_contrarian(spark, sf):
    signal = sig.signal("rsi_contrarian", oversold=45, overbought=55)
    return _rsi_bars(spark, sf, 50).select(*BAR, signal.alias("signal"))


@query(
    "sig_pair",
    sql(
        "pair_1h",
        f"""WITH {pair_ctes(30)} SELECT symbol, ts,
        {decide('spread_z < -1', 'spread_z > 1 OR (spread_z >= 0.5 AND spread_z <= 1)')} FROM sz""",
    ),
)
def sig_pair(spark, sf):
    bars = ind.pair_spread(fx.pair(spark, sf), 30)
    return bars.select(*BAR, sig.signal("pair", entry=1.0, exit_threshold=0.5).alias("signal"))


@query(
    "sig_pair_symmetric",
    sql(
        "pair_1h",
        f"""WITH {pair_ctes(30)} SELECT symbol, ts, CASE WHEN spread_z BETWEEN -0.25 AND 0.25 THEN 0
            WHEN spread_z > 1 THEN -1 WHEN spread_z < -1 THEN 1 ELSE 0 END AS signal FROM sz""",
    ),
)
def sig_pair_symmetric(spark, sf):
    bars = ind.pair_spread(fx.pair(spark, sf), 30)
    return bars.select(*BAR, sig.signal("pair_symmetric", entry=1.0, exit_threshold=-0.25).alias("signal"))


def latch_sql(want: str, part: str) -> str:
    return sql(
        "scored",
        f"""WITH w AS (SELECT *, {want} AS want FROM scored),
        s AS (SELECT *, coalesce(last_value(want IGNORE NULLS) OVER ({part} ROWS UNBOUNDED PRECEDING), 0) AS state FROM w)
        SELECT event_id, symbol, CAST(state - coalesce(lag(state) OVER ({part}), 0) AS INTEGER) AS signal FROM s""",
    )


_PROB = "CASE WHEN probability >= 0.55 THEN 1 WHEN probability <= 0.45 THEN 0 END"


def _probability(name: str, part: str, layout):
    @query(name, latch_sql(_PROB, part))
    def run(spark, sf):
        ticks, own = fx.cut(fx.scored_ticks(spark, sf), layout)
        return pos.latch_probability(ticks, layout=own).select("event_id", "symbol", "signal")


_probability("sig_probability", WS, BARS)
_probability("sig_probability_daily_reset", WD, DAY_LAYOUT)


@query("sig_prediction", latch_sql("CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 END", WS))
def sig_prediction(spark, sf):
    n = F.col("event_id") % 3
    ticks = fx.scored_ticks(spark, sf).withColumn("prediction", F.when(n < 2, 1 - n))
    ticks, layout = fx.cut(ticks)
    return pos.latch_prediction(ticks, layout).select("event_id", "symbol", "signal")
