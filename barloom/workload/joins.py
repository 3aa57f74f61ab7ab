"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import intraday, joins
from barloom.plans.grids import ParamGrid
from barloom.workload import fixtures as fx
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import BAR, DAY, out, r6


@query(
    "join_dividends",
    sql(
        "bars_1h dividends",
        """
        SELECT b.symbol, b.ts, coalesce(d.dividend, 0) AS dividend
        FROM bars_1h b LEFT JOIN dividends d ON b.symbol = d.symbol AND b.day = d.day""",
    ),
)
def join_dividends(spark, sf):
    return joins.join_dividends(fx.bars(spark, sf), fx.dividends(spark, sf)).select(*BAR, "dividend")


_VOL = """
    SELECT symbol, day, CASE WHEN count(ret) OVER w = 15 THEN stddev_samp(ret) OVER w END AS ticker_dvol
    FROM daily_ret
    WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)"""


@query(
    "join_daily_vol",
    sql(
        "bars_1h daily_ret",
        f"""
        SELECT b.symbol, b.ts, round(v.ticker_dvol, 6) AS ticker_dvol
        FROM bars_1h b LEFT JOIN ({_VOL}) v ON b.symbol = v.symbol AND b.day = v.day""",
    ),
)
def join_daily_vol(spark, sf):
    return out(intraday.join_daily_vol(fx.bars(spark, sf), fx.daily(spark, sf)), BAR, "ticker_dvol")


@query(
    "asof_risk_free",
    sql(
        "daily_ret rf_daily",
        """
        SELECT d.symbol, d.day, round(f.rf_daily, 9) AS rf_daily, round(d.ret - f.rf_daily, 6) AS excess
        FROM daily_ret d JOIN rf_daily f ON d.day = f.day""",
    ),
)
def asof_risk_free(spark, sf):
    from barloom.workload.aggregates import daily_returns

    days = joins.asof_risk_free(daily_returns(spark, sf), fx.risk_free(spark, sf))
    return days.select(
        *DAY, F.round("rf_daily", 9).alias("rf_daily"), F.round(F.col("ret") - F.col("rf_daily"), 6).alias("excess")
    )


@query(
    "asof_benchmark_return",
    sql(
        "daily long_ret",
        """
        , axis AS (SELECT s.symbol, d.day FROM (SELECT DISTINCT symbol FROM daily_long) s,
                  (SELECT DISTINCT day FROM daily_long) d),
        bench AS (SELECT symbol, day, ret FROM long_ret)
        SELECT a.symbol, a.day, round(b.ret, 6) AS ret_ticker
        FROM axis a ASOF LEFT JOIN bench b ON a.symbol = b.symbol AND a.day >= b.day""".replace(
            "        , axis", "WITH axis", 1
        ),
    ),
)
def asof_benchmark_return(spark, sf):
    """Every series on every day on which any series has a price."""
    prices = fx.daily_long(spark, sf)
    # one row that lists the symbols of the table
    symbols = prices.agg(F.collect_set("symbol").alias("symbols"))
    every = prices.select("day").distinct().join(F.broadcast(symbols)).select("day", F.explode("symbols").alias("symbol"))
    return out(joins.asof_benchmark_return(every, prices), DAY, "ret_ticker")


@query(
    "align_returns",
    sql(
        "daily_ret",
        """
        SELECT a.symbol, a.day, round(a.ret, 6) AS ret, round(b.ret, 6) AS ret_ticker
        FROM daily_ret a JOIN daily_ret b ON a.day = b.day AND b.symbol = 'view'
        WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL""",
    ),
)
def align_returns(spark, sf):
    from barloom.workload.aggregates import aligned

    return out(aligned(spark, sf), DAY, "ret", "ret_ticker")


@query("join_pair", sql("pair_1h", "SELECT symbol, ts, day, close_a, close_b FROM pair_1h"))
def join_pair(spark, sf):
    return fx.pair(spark, sf).select("symbol", "ts", "day", "close_a", "close_b")


@query(
    "join_pair_on_ts",
    sql(
        "bars_5m",
        """
        SELECT 'click/view' AS symbol, a.ts, a.close AS close_a, b.close AS close_b
        FROM bars_5m a JOIN bars_5m b ON a.ts = b.ts AND a.symbol = 'click' AND b.symbol = 'view'""",
    ),
)
def join_pair_on_ts(spark, sf):
    return joins.join_pair(fx.bars(spark, sf, 5), "click", "view", on="ts").select("symbol", "ts", "close_a", "close_b")


@query(
    "join_prev_day",
    sql(
        "bars_1h dividends",
        """
        WITH d AS (
            SELECT symbol, day, arg_min(open, ts) AS day_open, arg_max(close, ts) AS close FROM bars_1h GROUP BY 1, 2),
        v AS (SELECT symbol, day, max(dividend) AS dividend FROM dividends GROUP BY 1, 2),
        p AS (
            SELECT d.symbol, d.day, d.day_open, lag(d.close) OVER w AS prev_close,
                   lag(coalesce(v.dividend, 0)) OVER w AS prev_dividend
            FROM d LEFT JOIN v ON d.symbol = v.symbol AND d.day = v.day
            WINDOW w AS (PARTITION BY d.symbol ORDER BY d.day))
        SELECT b.symbol, b.ts, p.day_open, p.prev_close, p.prev_dividend
        FROM bars_1h b JOIN p ON b.symbol = p.symbol AND b.day = p.day WHERE p.prev_close IS NOT NULL""",
    ),
)
def join_prev_day(spark, sf):
    bars = fx.bars(spark, sf)
    paid = fx.dividends(spark, sf).groupBy("symbol", "day").agg(F.max("dividend").alias("dividend"))
    day = fx.daily(spark, sf).join(paid, ["symbol", "day"], "left")
    return joins.join_prev_day(bars, day).select(*BAR, "day_open", "prev_close", "prev_dividend")


@query(
    "join_scores",
    sql(
        "bars_5m scored",
        """
        SELECT b.symbol, b.ts, s.probability
        FROM bars_5m b LEFT JOIN (
            SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, max(probability) AS probability
            FROM scored GROUP BY 1, 2) s ON b.symbol = s.symbol AND b.ts = s.ts""",
    ),
)
def join_scores(spark, sf):
    return joins.join_scores(fx.bars(spark, sf, 5), bar_scores(spark, sf)).select(*BAR, "probability")


def bar_scores(spark, sf, minutes: int = 5):
    scores = fx.scored_ticks(spark, sf)
    return (
        scores.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.max("probability").alias("probability"))
        .select("symbol", F.col("w.start").alias("ts"), "probability")
    )


@query(
    "cross_param_grid",
    sql(
        "bars_1h",
        """
        SELECT b.symbol, b.ts, CAST(g.m * 3 + g.f AS INTEGER) AS config_id,
               [0.8, 1.0, 1.2][g.m + 1]::DOUBLE AS band_mult, [30, 60, 120][g.f + 1] AS trade_freq,
               round(b.close * [0.8, 1.0, 1.2][g.m + 1]::DOUBLE, 6) AS band
        FROM bars_1h b, (SELECT m, f FROM range(3) a(m), range(3) c(f)) g""",
    ),
)
def cross_param_grid(spark, sf):
    grid = ParamGrid({"band_mult": [0.8, 1.0, 1.2], "trade_freq": [30, 60, 120]})
    many = grid.multiply(fx.bars(spark, sf)).withColumn("band", F.col("close") * F.col("band_mult"))
    return out(many, (*BAR, "config_id"), "band_mult", "trade_freq", "band")


@query(
    "semi_latest_best",
    sql(
        "daily_ret",
        """
        SELECT d.symbol, d.day, d.close FROM daily_ret d SEMI JOIN (
            SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY avg(ret) DESC, symbol) AS r
                                FROM daily_ret GROUP BY symbol) WHERE r <= 2) b ON d.symbol = b.symbol""",
    ),
)
def semi_latest_best(spark, sf):
    from barloom.workload.aggregates import daily_returns

    days = daily_returns(spark, sf)
    best = days.groupBy("symbol").agg(F.avg("ret").alias("m")).orderBy(F.desc("m"), "symbol").limit(2)
    return joins.rows_of_best(days, best, ("symbol",)).select("symbol", "day", "close")
