"""Window functions, indicators and sizing.

The SQL side computes every recursive average step by step with a recursive CTE, so it shares
nothing with the chunked scans it checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions import bars as bar_fn
from barloom.functions import signals as sig
from barloom.functions.numeric import ratio
from barloom.operators import features as feat
from barloom.operators import indicators as ind
from barloom.operators import intraday, joins, sizing
from barloom.operators import metrics as m
from barloom.operators import positions as pos
from barloom.operators.series import BARS, DAY as DAY_LAYOUT
from barloom.workload import fixtures as fx
from barloom.workload.aggregates import daily_returns, long_returns
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import BAR, DAY, out, r6

WS = "PARTITION BY symbol ORDER BY ts"
WD = "PARTITION BY symbol, day ORDER BY ts"


def frame(n: int, skip: int = 0, part: str = WS) -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def full(fn: str, col: str, n: int, skip: int = 0, part: str = WS) -> str:
    w = frame(n, skip, part)
    return f"CASE WHEN count({col}) {w} = {n} THEN {fn}({col}) {w} END"


def bar_sql(body: str, uses: str = "bars_1h", src: str = "bars_1h") -> str:
    return sql(uses, f"SELECT symbol, ts, {body} FROM {src}")


VWAP_SQL = f"sum(volume * ((high + low + close) / 3)) OVER ({WD}) / nullif(sum(volume) OVER ({WD}), 0)"
MOVE_SQL = f"CASE WHEN first_value(open) OVER ({WD}) = 0 THEN 0 ELSE abs(close / nullif(first_value(open) OVER ({WD}), 0) - 1) END"


@query("vwap", bar_sql(f"round({VWAP_SQL}, 6) AS vwap"))
def vwap(spark, sf):
    return out(intraday.vwap(fx.bars(spark, sf)), BAR, "vwap")


@query("move_open", bar_sql(f"round({MOVE_SQL}, 6) AS move_open"))
def move_open(spark, sf):
    return out(intraday.move_open(fx.bars(spark, sf)), BAR, "move_open")


_TICK_DAY = {"vwap": VWAP_SQL, "move_open": MOVE_SQL, "position": f"row_number() OVER ({WD})"}


@query("day_columns_ticks", bar_sql(", ".join(f"round({c}, 6) AS {n}" if n != "position" else f"{c} AS {n}" for n, c in _TICK_DAY.items()), "ticks", "ticks"))
def day_columns_ticks(spark, sf):
    """The columns of a day so far on ticks, whose days may be longer than a task."""
    ticks, layout = fx.cut(fx.ticks(spark, sf), DAY_LAYOUT)
    ready = intraday.move_open(intraday.vwap(ticks, layout), layout)
    done = intraday.minute_index_by_position(ready, layout).withColumn("position", F.col("min_from_open").cast("bigint"))
    return out(done, [*BAR, "position"], "vwap", "move_open")


@query(
    "daily_vol",
    sql(
        "daily_ret",
        """
        SELECT symbol, day, round(CASE WHEN count(ret) OVER w = 15 THEN stddev_samp(ret) OVER w END, 6) AS ticker_dvol,
               round(CASE WHEN count(ret) OVER v = 15 THEN stddev_samp(ret) OVER v END, 6) AS ticker_dvol_lagged
        FROM daily_ret
        WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW),
               v AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)""",
    ),
)
def daily_vol(spark, sf):
    now = intraday.daily_vol(fx.daily(spark, sf))
    lagged = intraday.daily_vol(now.withColumnRenamed("ticker_dvol", "now"), lag=1)
    done = lagged.withColumnRenamed("ticker_dvol", "ticker_dvol_lagged").withColumnRenamed("now", "ticker_dvol")
    return out(done, DAY, "ticker_dvol", "ticker_dvol_lagged")


@query(
    "minute_index",
    bar_sql(
        f"CAST(hour(ts) * 60 + minute(ts) - 569 AS INTEGER) AS min_from_open, "
        f"CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, row_number() OVER ({WD}) AS position",
        "bars_5m",
        "bars_5m",
    ),
)
def minute_index(spark, sf):
    bars = fx.bars(spark, sf, 5)
    by_position = intraday.minute_index_by_position(bars).withColumnRenamed("min_from_open", "position")
    return intraday.minute_index(by_position).select(*BAR, "min_from_open", "minute_of_day", "position")


SIGMA_CTES = f"""
    mo AS (SELECT *, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, {MOVE_SQL} AS move_open,
                  {VWAP_SQL} AS vwap FROM bars_1h),
    sg AS (SELECT *, CASE WHEN count(move_open) OVER w >= 13 THEN avg(move_open) OVER w END AS move_open_rolling_mean,
                  CASE WHEN count(move_open) OVER w >= 13 THEN stddev_samp(move_open) OVER w END AS sigma_open
           FROM mo WINDOW w AS (PARTITION BY symbol, minute_of_day ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))"""


@query(
    "sigma_open",
    sql("bars_1h", f"WITH {SIGMA_CTES} SELECT symbol, ts, {r6('move_open_rolling_mean', 'sigma_open')} FROM sg"),
)
def sigma_open(spark, sf):
    derived = intraday.derived_columns(fx.bars(spark, sf), fx.daily(spark, sf))
    return out(derived, BAR, "move_open_rolling_mean", "sigma_open")


@query("lags", bar_sql(", ".join(f"lag({c}) OVER ({WS}) AS prev_{c}" for c in feat.RAW)))
def lags(spark, sf):
    return ind.lags(fx.bars(spark, sf)).select(*BAR, *[f"prev_{c}" for c in feat.RAW])


_STD = {f"vol_{n}": full("stddev_samp", "close", n) for n in ind.WINDOWS}
_SMA = {f"ma_{n}": full("avg", "close", n) for n in ind.WINDOWS}


def rounded(cols: dict[str, str]) -> str:
    return ", ".join(f"round({c}, 6) + 0 AS {n}" for n, c in cols.items())


@query("rolling_std", bar_sql(rounded(_STD)))
def rolling_std(spark, sf):
    return out(ind.rolling_std(fx.bars(spark, sf)), BAR, *_STD)


@query("sma", bar_sql(rounded(_SMA)))
def sma(spark, sf):
    return out(ind.sma(fx.bars(spark, sf)), BAR, *_SMA)


def _smoothed() -> tuple[str, list[str]]:
    """One recursive CTE that walks every series bar by bar and updates all recursive averages."""
    spans = sorted({*ind.EMA_SPANS, *[s for a, b, _ in ind.MACD.values() for s in (a, b)]})
    e = [f"e{s}" for s in spans]
    base = [f"close AS {n}" for n in e]
    step = [f"b.close * (2.0::DOUBLE / {s + 1}) + r.e{s} * (1 - 2.0::DOUBLE / {s + 1}) AS e{s}" for s in spans]
    carry = []
    for p in ind.RSI_PERIODS:
        base += [f"0::DOUBLE AS g{p}", f"0::DOUBLE AS l{p}"]
        keep = f"(1 - 1.0::DOUBLE / {p})"
        step += [f"r.g{p} * {keep} + greatest(b.d, 0) AS g{p}", f"r.l{p} * {keep} + greatest(-b.d, 0) AS l{p}"]
    for name, (_, _, s) in ind.MACD.items():
        base.append(f"0::DOUBLE AS s_{name}")
        step.append(f"r.s_{name} AS s_{name}")
    names = [x.split(" AS ")[-1] for x in base]
    last = []
    for n in names:
        if n.startswith("s_"):
            fast, slow, s = ind.MACD[n[2:]]
            last.append(f"(e{fast} - e{slow}) * (2.0::DOUBLE / {s + 1}) + {n} * (1 - 2.0::DOUBLE / {s + 1}) AS {n}")
        else:
            last.append(n)
    cte = f"""
    nb AS MATERIALIZED (SELECT symbol, ts, close, close - lag(close) OVER ({WS}) AS d,
                        row_number() OVER ({WS}) - 1 AS i FROM bars_1h),
    rs AS (SELECT symbol, ts, close, i, {", ".join(base)} FROM nb WHERE i = 0
           UNION ALL
           SELECT symbol, ts, close, i, {", ".join(last)} FROM (
               SELECT b.symbol, b.ts, b.close, b.i, {", ".join(step)}
               FROM rs r JOIN nb b ON b.symbol = r.symbol AND b.i = r.i + 1)),
    smooth AS (SELECT symbol, ts, {", ".join(f"e{s} AS ema_{s}" for s in ind.EMA_SPANS)},
               {", ".join(f"CASE WHEN i >= {p} THEN 100 - 100 / (1 + g{p} / nullif(l{p}, 0)) END AS rsi_{p}" for p in ind.RSI_PERIODS)},
               {", ".join(f"e{f} - e{s} - s_{n} AS {n}" for n, (f, s, _) in ind.MACD.items())} FROM rs)"""
    return cte, carry


SMOOTH_CTES, _ = _smoothed()


def smooth_sql(*names: str) -> str:
    return sql("bars_1h", f"WITH {SMOOTH_CTES} SELECT symbol, ts, {r6(*names)} FROM smooth", recursive=True)


def rsi_direct_sql(src: str, periods) -> str:
    """RSI of each row from its whole past, weighted by age: no recursion, no running sums."""
    sums = ", ".join(
        f"sum(greatest(p.d, 0) * pow(({n} - 1.0) / {n}, r.i - p.i)) / nullif(sum(greatest(-p.d, 0) * pow(({n} - 1.0) / {n}, r.i - p.i)), 0) AS rs_{n}" for n in periods
    )
    return f"""WITH d AS (SELECT symbol, ts, close - lag(close) OVER ({WS}) AS d, row_number() OVER ({WS}) - 1 AS i FROM {src}),
        w AS (SELECT r.symbol, r.ts, r.i, {sums} FROM d r LEFT JOIN d p ON p.symbol = r.symbol AND p.i <= r.i AND p.i > r.i - 1200 AND p.i > 0 GROUP BY ALL)
        SELECT symbol, ts, {", ".join(f"round(CASE WHEN i >= {n} THEN 100 - 100 / (1 + rs_{n}) END, 6) AS rsi_{n}" for n in periods)} FROM w"""


_EMA = [f"ema_{s}" for s in ind.EMA_SPANS]
_RSI = [f"rsi_{p}" for p in ind.RSI_PERIODS]


@query("ema", smooth_sql(*_EMA))
def ema(spark, sf):
    return out(ind.ema(fx.bars(spark, sf)), BAR, *_EMA)


@query("rsi_ewm_ticks", sql("ticks", rsi_direct_sql("ticks", (5, 14))))
def rsi_ewm_ticks(spark, sf):
    ticks, layout = fx.cut(fx.ticks(spark, sf))
    return out(ind.rsi_ewm(ticks, (5, 14), layout), BAR, "rsi_5", "rsi_14")


@query("rsi_ewm", smooth_sql(*_RSI))
def rsi_ewm(spark, sf):
    return out(ind.rsi_ewm(fx.bars(spark, sf)), BAR, *_RSI)


@query("macd_hist", smooth_sql(*ind.MACD))
def macd_hist(spark, sf):
    return out(ind.macd_hist(fx.bars(spark, sf)), BAR, *ind.MACD)


def walk(src: str, part: str, value: str, period: int, c: str, first: int, name: str) -> str:
    """Recursive average of ``value`` seeded with the mean of ``period`` values from row ``first``."""
    keys = [k.strip() for k in part.split(",")]
    on = " AND ".join(f"b.{k} = r.{k}" for k in keys)
    start = first + period - 1
    return f"""
    n_{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ts) - 1 AS i,
        avg({value}) OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) AS seed
        FROM {src}),
    {name} AS (SELECT {part}, ts, i, seed AS y FROM n_{name} WHERE i = {start}
        UNION ALL SELECT {", ".join(f"b.{k}" for k in keys)}, b.ts, b.i, r.y * {c} + b.{value} * (1 - {c})
        FROM {name} r JOIN n_{name} b ON {on} AND b.i = r.i + 1)"""


@query(
    "ema_sma_seed",
    sql(
        "bars_1h",
        f"""WITH {walk('bars_1h', 'symbol', 'close', 20, '(19.0::DOUBLE / 21)', 0, 'em')}
        SELECT b.symbol, b.ts, round(y, 6) AS ema FROM bars_1h b LEFT JOIN em USING (symbol, ts)""",
        recursive=True,
    ),
)
def ema_sma_seed(spark, sf):
    return out(ind.ema_sma_seed(fx.bars(spark, sf), 20), BAR, "ema")


def rsi_wilder_ctes(src: str, part: str, p: int, tag: str = "") -> str:
    """CTE ``rw`` with column rsi; ``part`` lists the key columns of a series."""
    d = f"close - lag(close) OVER (PARTITION BY {part} ORDER BY ts)"
    c = f"({p - 1}.0::DOUBLE / {p})"
    return f"""
    dl{tag} AS (SELECT *, greatest({d}, 0) AS gain, greatest(-({d}), 0) AS fall FROM {src}),
    {walk(f'dl{tag}', part, 'gain', p, c, 1, f'wg{tag}')},
    {walk(f'dl{tag}', part, 'fall', p, c, 1, f'wl{tag}')},
    rw{tag} AS (SELECT g.symbol, g.ts, CASE WHEN l.y = 0 THEN 100 ELSE 100 - 100 / (1 + g.y / nullif(l.y, 0)) END AS rsi
            FROM wg{tag} g JOIN wl{tag} l ON g.symbol = l.symbol AND g.ts = l.ts)"""


@query(
    "rsi_wilder",
    sql(
        "bars_1h",
        f"""WITH {rsi_wilder_ctes('bars_1h', 'symbol', 14)}
        SELECT b.symbol, b.ts, round(rsi, 6) AS rsi FROM bars_1h b LEFT JOIN rw USING (symbol, ts)""",
        recursive=True,
    ),
)
def rsi_wilder(spark, sf):
    return out(ind.rsi_wilder(fx.bars(spark, sf)), BAR, "rsi")


_LOGS = {
    f"lr_{c}": f"coalesce(ln(nullif({c}, 0)) - lag(ln(nullif({c}, 0))) OVER ({WS}), 0)"
    for c in ("open", "high", "low", "close")
} | {"r_volume": f"coalesce(volume - lag(volume) OVER ({WS}), 0)"}
_Z = {
    f"zscore_{n}": f"CASE WHEN count(close) {frame(n)} = {n} THEN (close - avg(close) {frame(n)}) / nullif(stddev_samp(close) {frame(n)}, 0) END"
    for n in (20, 30)
}
_MOM = {f"momentum_{n}": f"close / nullif(lag(close, {n}) OVER ({WS}), 0) - 1" for n in (1, 5, 10)}
_POSN = {
    "price_position": "(close - low) / nullif(high - low, 0)",
    "dist_from_high": "(high - close) / nullif(high, 0)",
    "dist_from_low": "(close - low) / nullif(close, 0)",
}
_PEAK = f"max(close) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DD = f"(close - {_PEAK}) / {_PEAK}"


def z_lagged(n: int, col: str = "close", part: str = WS) -> str:
    w = frame(n, 1, part)
    return f"CASE WHEN count({col}) {w} = {n} THEN ({col} - avg({col}) {w}) / nullif(stddev_pop({col}) {w}, 0) END"


@query("log_returns", bar_sql(rounded(_LOGS)))
def log_returns(spark, sf):
    return out(ind.log_returns(fx.bars(spark, sf)), BAR, *_LOGS)


@query("zscore_incl", bar_sql(rounded(_Z)))
def zscore_incl(spark, sf):
    return out(ind.zscore_incl(fx.bars(spark, sf)), BAR, *_Z)


@query("zscore_lagged", bar_sql(rounded({"z_20": z_lagged(20), "z_10": z_lagged(10)})))
def zscore_lagged(spark, sf):
    return out(ind.zscore_lagged(fx.bars(spark, sf), [10, 20]), BAR, "z_10", "z_20")


@query("sma_lagged", bar_sql(rounded({"sma_50": full("avg", "close", 50, 1), "sma_200": full("avg", "close", 200, 1)})))
def sma_lagged(spark, sf):
    return out(ind.sma_lagged(fx.bars(spark, sf), [50, 200]), BAR, "sma_50", "sma_200")


@query("momentum", bar_sql(rounded(_MOM)))
def momentum(spark, sf):
    return out(ind.momentum(fx.bars(spark, sf)), BAR, *_MOM)


_VOLUME = {
    "volume_ma_20": full("avg", "volume", 20),
    "volume_ratio": f"volume / nullif({full('avg', 'volume', 20)}, 0)",
    "vwap_deviation": "(close - vwap) / nullif(vwap, 0)",
}


@query("volume_features", sql("bars_1h", f"SELECT symbol, ts, {rounded(_VOLUME)} FROM (SELECT *, {VWAP_SQL} AS vwap FROM bars_1h)"))
def volume_features(spark, sf):
    return out(ind.volume_features(intraday.vwap(fx.bars(spark, sf))), BAR, *_VOLUME)


_RISK = {
    "rolling_sharpe": f"CASE WHEN count(ret) {frame(20)} = 20 THEN avg(ret) {frame(20)} / nullif(stddev_samp(ret) {frame(20)}, 0) END",
    "rolling_sortino": f"CASE WHEN count(ret) {frame(20)} = 20 THEN avg(ret) {frame(20)} / nullif(stddev_samp(least(ret, 0)) {frame(20)}, 0) END",
}
# least() skips NULL in DuckDB; a missing return must stay missing.
_RISK = {n: c.replace("least(ret, 0)", "CASE WHEN ret > 0 THEN 0 ELSE ret END") for n, c in _RISK.items()}
_RET = f"SELECT *, close / nullif(lag(close) OVER ({WS}), 0) - 1 AS ret FROM bars_1h"


@query("rolling_risk", sql("bars_1h", f"SELECT symbol, ts, {rounded(_RISK)} FROM ({_RET})"))
def rolling_risk(spark, sf):
    return out(ind.rolling_risk(fx.bars(spark, sf)), BAR, *_RISK)


@query("drawdown_series", bar_sql(f"round({_DD}, 6) AS drawdown", "ticks", "ticks"))
def drawdown_series(spark, sf):
    ticks, layout = fx.cut(fx.ticks(spark, sf))
    return out(ind.drawdown_series(ticks, layout=layout), BAR, "drawdown")


@query("price_position", bar_sql(rounded(_POSN)))
def price_position(spark, sf):
    return out(fx.bars(spark, sf).withColumns(bar_fn.price_position()), BAR, *_POSN)


_CLOCK = {
    "minute_of_day": "CAST(hour(ts) * 60 + minute(ts) AS INTEGER)",
    "min_from_open": "CAST(hour(ts) * 60 + minute(ts) - 570 AS INTEGER)",
    "time_of_day_pct": "round((hour(ts) * 60 + minute(ts) - 570) / 390.0::DOUBLE, 6)",
    "hour_of_day": "CAST(hour(ts) AS INTEGER)",
    "day_of_week": "CAST(isodow(ts) - 1 AS INTEGER)",
    "near_open": "CAST(hour(ts) * 60 + minute(ts) - 570 <= 30 AS INTEGER)",
    "near_close": "CAST(hour(ts) * 60 + minute(ts) - 570 >= 360 AS INTEGER)",
}


def plain(cols: dict[str, str]) -> str:
    return ", ".join(f"{c} AS {n}" for n, c in cols.items())


@query("time_features", bar_sql(plain(_CLOCK), "bars_5m", "bars_5m"))
def time_features(spark, sf):
    return out(fx.bars(spark, sf, 5).withColumns(bar_fn.time_features()), BAR, *_CLOCK)


@query(
    "time_features_by_position",
    sql(
        "bars_5m",
        f"""SELECT symbol, ts, CAST(p + 570 AS INTEGER) AS minute_of_day, CAST(p AS INTEGER) AS min_from_open,
               round(p / 390.0::DOUBLE, 6) AS time_of_day_pct, CAST((p + 570) // 60 AS INTEGER) AS hour_of_day,
               0 AS day_of_week, CAST(p <= 30 AS INTEGER) AS near_open, CAST(p >= 360 AS INTEGER) AS near_close
            FROM (SELECT *, row_number() OVER ({WD}) - 1 AS p FROM bars_5m)""",
    ),
)
def time_features_by_position(spark, sf):
    numbered = intraday.minute_index_by_position(fx.bars(spark, sf, 5))
    return out(numbered.withColumns(bar_fn.time_features_by_position(F.col("min_from_open") - 1)), BAR, *_CLOCK)


_HOLES = "CASE WHEN hour(ts) % 4 = 0 THEN NULL WHEN hour(ts) = 5 THEN 'inf'::DOUBLE ELSE close END"


@query(
    "impute_fill",
    sql(
        "ticks",
        f"""WITH h AS (SELECT event_id, symbol, ts, {_HOLES} AS x FROM ticks),
        c AS (SELECT *, CASE WHEN isinf(x) OR isnan(x) THEN NULL ELSE x END AS y FROM h)
        SELECT event_id, symbol, coalesce(
            last_value(y IGNORE NULLS) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(y IGNORE NULLS) OVER ({WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x FROM c""",
    ),
)
def impute_fill(spark, sf):
    hour = F.hour("ts")
    holes = F.when(hour % 4 == 0, F.lit(None)).when(hour == 5, F.lit(float("inf"))).otherwise(F.col("close"))
    ticks, layout = fx.cut(fx.ticks(spark, sf))
    return feat.impute_fill(ticks.withColumn("x", holes), ["x"], layout).select("event_id", "symbol", "x")


@query(
    "ohlc_fallback",
    sql(
        "bars_1h",
        f"""SELECT symbol, ts, first_value(open) OVER ({WD}) AS open, max(close) OVER ({WD}) AS high,
               min(close) OVER ({WD}) AS low, close FROM bars_1h""",
    ),
)
def ohlc_fallback(spark, sf):
    bars = joins.join_by_day(
        fx.bars(spark, sf), fx.daily(spark, sf).withColumnRenamed("open", "day_open"), "day_open"
    )
    return intraday.ohlc_fallback(bars).select(*BAR, "open", "high", "low", "close")


_MATRIX = (
    {f"prev_{c}": f"lag({c}) OVER ({WS})" for c in feat.RAW}
    | _STD
    | _SMA
    | _LOGS
    | _Z
    | _MOM
    | _VOLUME
    | _RISK
    | {"drawdown": _DD}
    | _POSN
)


def matrix_ctes() -> str:
    names = [*_MATRIX, *_EMA, *_RSI, *ind.MACD, "time_of_day_pct"]
    fill = ", ".join(
        f"coalesce(last_value({n} IGNORE NULLS) OVER up, first_value({n} IGNORE NULLS) OVER down, 0) AS {n}" for n in names
    )
    clock = {k: v for k, v in _CLOCK.items() if k != "time_of_day_pct"}
    return f"""
    {SMOOTH_CTES},
    mb AS (SELECT *, {VWAP_SQL} AS vwap, close / nullif(lag(close) OVER ({WS}), 0) - 1 AS ret FROM bars_1h),
    mr AS (SELECT *, {plain(_MATRIX)}, (hour(ts) * 60 + minute(ts) - 570) / 390.0::DOUBLE AS time_of_day_pct FROM mb),
    mx AS (SELECT * FROM mr JOIN smooth USING (symbol, ts)),
    matrix AS (SELECT symbol, ts, day, open, high, low, close, volume, {fill}, {plain(clock)},
               row_number() OVER ({WS}) AS rn, count(*) OVER (PARTITION BY symbol) AS cnt
        FROM mx WINDOW up AS ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             down AS ({WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


MATRIX_FLOATS = [*_MATRIX, *_EMA, *_RSI, *ind.MACD, "time_of_day_pct"]
MATRIX_INTS = [n for n in _CLOCK if n != "time_of_day_pct"]
MATRIX_COLUMNS = [*MATRIX_FLOATS, *MATRIX_INTS]


@query(
    "feature_matrix",
    sql(
        "bars_1h",
        f"""WITH {matrix_ctes()} SELECT symbol, ts, {r6(*MATRIX_FLOATS)}, {", ".join(MATRIX_INTS)}
        FROM matrix WHERE rn > 60 OR cnt <= 60""",
        recursive=True,
    ),
)
def feature_matrix(spark, sf):
    return out(feat.feature_matrix(intraday.vwap(fx.bars(spark, sf))), BAR, *MATRIX_COLUMNS)


# ---------------------------------------------------------------- bands, per day

TR_SQL = f"""SELECT *, greatest(high - low, abs(high - lag(close) OVER ({WD})), abs(low - lag(close) OVER ({WD}))) AS true_range
    FROM {{src}}"""


def atr_ctes(src: str, p: int, tag: str = "") -> str:
    return f"""
    tr{tag} AS MATERIALIZED ({TR_SQL.format(src=src)}),
    {walk(f'tr{tag}', 'symbol, day', 'true_range', p, f'({p - 1}.0::DOUBLE / {p})', 0, f'av{tag}')}"""


@query("true_range", sql("bars_1h", f"SELECT symbol, ts, round(true_range, 6) AS true_range FROM ({TR_SQL.format(src='bars_1h')})"))
def true_range(spark, sf):
    return out(ind.true_range(fx.bars(spark, sf)), BAR, "true_range")


@query(
    "atr",
    sql(
        "bars_5m",
        f"""WITH {atr_ctes('bars_5m', 14)} SELECT b.symbol, b.ts, round(y, 6) AS atr_14
        FROM bars_5m b LEFT JOIN av USING (symbol, ts)""",
        recursive=True,
    ),
)
def atr(spark, sf):
    return out(ind.atr(fx.bars(spark, sf, 5)), BAR, "atr_14")


def _refs(spark, sf):
    bars = fx.bars(spark, sf, 5)
    high, low = sig.reference_prices()
    day = fx.daily(spark, sf)
    return joins.join_prev_day(bars, day).withColumns({"ref_high": high, "ref_low": low})


REF_CTES = """
    pd AS (SELECT symbol, day, open AS day_open, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prev_close FROM daily),
    rf AS (SELECT b.*, greatest(day_open, prev_close) AS ref_high, least(day_open, prev_close) AS ref_low
           FROM bars_5m b JOIN pd USING (symbol, day) WHERE prev_close IS NOT NULL)"""


@query(
    "atr_bands",
    sql(
        "bars_5m daily",
        f"""WITH {REF_CTES}, {atr_ctes("rf", 14)}
        SELECT symbol, ts, round(ref_high + 2 * y, 6) AS upper_band, round(ref_low - 2 * y, 6) AS lower_band
        FROM rf LEFT JOIN av USING (symbol, ts)""",
        recursive=True,
    ),
)
def atr_bands(spark, sf):
    return out(ind.atr_bands(ind.atr(_refs(spark, sf)), 2.0), BAR, "upper_band", "lower_band")


@query(
    "trailing_atr_bands",
    sql(
        "bars_5m",
        f"""WITH {atr_ctes('bars_5m', 14)}
        SELECT b.symbol, b.ts, round(max(high) OVER w + 2 * y * 0.1::DOUBLE, 6) AS upper_band,
               round(min(low) OVER w - 2 * y * 0.1::DOUBLE, 6) AS lower_band
        FROM bars_5m b LEFT JOIN av USING (symbol, ts)
        WINDOW w AS (PARTITION BY b.symbol, b.day ORDER BY b.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
        recursive=True,
    ),
)
def trailing_atr_bands(spark, sf):
    return out(ind.trailing_atr_bands(fx.bars(spark, sf, 5)), BAR, "upper_band", "lower_band")


@query(
    "keltner_bands",
    sql(
        "bars_5m",
        f"""WITH {atr_ctes('bars_5m', 14)}, {walk('bars_5m', 'symbol, day', 'close', 20, '(19.0::DOUBLE / 21)', 0, 'em')}
        SELECT b.symbol, b.ts, round(em.y + 2 * av.y, 6) AS upper_band, round(em.y - 2 * av.y, 6) AS lower_band
        FROM bars_5m b LEFT JOIN av USING (symbol, ts) LEFT JOIN em USING (symbol, ts)""",
        recursive=True,
    ),
)
def keltner_bands(spark, sf):
    return out(ind.keltner_bands(fx.bars(spark, sf, 5)), BAR, "upper_band", "lower_band")


# ---------------------------------------------------------------- pairs


def pair_ctes(n: int, part: str = WS) -> str:
    w = f"({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""
    hr AS (SELECT *, CASE WHEN count(close_b) OVER w = {n} THEN
               CASE WHEN avg(close_b) OVER w > 0 THEN avg(close_a) OVER w / avg(close_b) OVER w ELSE 1 END END AS hedge_ratio
           FROM pair_1h WINDOW w AS {w}),
    sp AS (SELECT *, close_a - hedge_ratio * close_b AS spread FROM hr),
    sz AS (SELECT *, {z_lagged(n, 'spread', part)} AS spread_z FROM sp)"""


def _pair_sql(col: str, n: int = 30) -> str:
    return sql("pair_1h", f"WITH {pair_ctes(n)} SELECT symbol, ts, round({col}, 6) AS {col} FROM sz")


def _pair(name: str, col: str):
    @query(name, _pair_sql(col))
    def run(spark, sf):
        return out(ind.pair_spread(fx.pair(spark, sf), 30), BAR, col)

    return run


_pair("hedge_ratio", "hedge_ratio")
_pair("spread", "spread")
_pair("spread_zscore", "spread_z")


@query(
    "spread_fixed_hedge",
    sql(
        "pair_1h",
        f"""WITH sp AS (SELECT *, close_a - 0.8::DOUBLE * close_b AS spread FROM pair_1h)
        SELECT symbol, ts, round(spread, 6) AS spread, round({z_lagged(30, 'spread')}, 6) AS spread_z FROM sp""",
    ),
)
def spread_fixed_hedge(spark, sf):
    return out(ind.pair_spread(fx.pair(spark, sf), 30, hedge=0.8), BAR, "spread", "spread_z")


# ---------------------------------------------------------------- sizing, per day

_DAYW = "PARTITION BY symbol ORDER BY day"
_KEYS = ("symbol",)


def day_sql(body: str, uses: str = "long_ret") -> str:
    return sql(uses, f"SELECT symbol, day, {body} FROM {uses.split()[0]}")


def _days(spark, sf, **cols):
    return out(long_returns(spark, sf).withColumns(cols), DAY, *cols)


@query(
    "rolling_vol",
    day_sql(
        f"round({full('stddev_samp', 'ret', 20, 0, _DAYW)}, 6) AS vol, round({full('stddev_pop', 'ret', 20, 0, _DAYW)}, 6) AS vol_pop"
    ),
)
def rolling_vol(spark, sf):
    r = F.col("ret")
    return _days(
        spark, sf, vol=sizing.rolling_vol(r, _KEYS), vol_pop=sizing.rolling_vol(r, _KEYS, population=True)
    )


_W20 = frame(20, 0, _DAYW)
_TS = f"CASE WHEN count(ret) {_W20} = 20 THEN CASE WHEN stddev_pop(ret) {_W20} > 0 THEN avg(ret) {_W20} / stddev_pop(ret) {_W20} ELSE 0 END END"


@query("trailing_sharpe", day_sql(f"round({_TS}, 6) AS trailing_sharpe"))
def trailing_sharpe(spark, sf):
    return _days(spark, sf, trailing_sharpe=sizing.trailing_sharpe(F.col("ret"), _KEYS))


@query(
    "trailing_var",
    sql(
        "long_ret",
        f"""WITH l AS (SELECT symbol, day, list_sort(list(ret) FILTER (WHERE ret IS NOT NULL) {frame(20, 1, _DAYW)}) AS r FROM long_ret)
        SELECT symbol, day, round(CASE WHEN len(r) >= 2
            THEN -r[CAST(floor((1::DOUBLE - 0.95::DOUBLE) * len(r)) AS BIGINT) + 1] END, 6) AS daily_var FROM l""",
    ),
)
def trailing_var(spark, sf):
    return out(sizing.trailing_var(long_returns(spark, sf), _KEYS), DAY, "daily_var")


@query(
    "sharpe_size",
    day_sql(f"CAST(trunc(1000 * CASE WHEN ({_TS}) IS NULL THEN 1 ELSE greatest(0.5, least(1.5, 1 + 0.2 * ({_TS}))) END) AS BIGINT) AS size"),
)
def sharpe_size(spark, sf):
    return _days(spark, sf, size=sizing.sharpe_size(F.col("ret"), _KEYS, 1000))


_W60 = frame(60, 0, _DAYW)
_SEEN = f"count(ret) OVER ({_DAYW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
KELLY_CTES = f"""
    kl AS (SELECT *, {_SEEN} AS seen, count(ret) {_W60} AS n,
           count(CASE WHEN ret > 0 THEN 1 END) {_W60} AS wins, count(CASE WHEN ret < 0 THEN 1 END) {_W60} AS losses,
           avg(CASE WHEN ret > 0 THEN ret END) {_W60} AS win, avg(CASE WHEN ret < 0 THEN -ret END) {_W60} AS loss,
           avg(ret) {_W60} AS mu, var_pop(ret) {_W60} AS var FROM long_ret),
    kr AS (SELECT *, CASE WHEN seen < 30 THEN 0 WHEN wins = 0 THEN -1 WHEN losses = 0 THEN 1
               ELSE wins / n::DOUBLE - (1 - wins / n::DOUBLE) / (win / greatest(loss, 1e-10)) END AS kelly_raw,
           CASE WHEN seen < 30 THEN 0 WHEN var < 1e-16 THEN CASE WHEN mu > 0 THEN 1 ELSE 0 END ELSE mu / var END AS cont_raw
           FROM kl)"""


def _kelly_sql(raw: str, tail: str) -> str:
    return sql(
        "long_ret",
        f"""WITH {KELLY_CTES} SELECT symbol, day, round({raw}, 6) AS {raw},
        CASE WHEN seen < 30 THEN 100000 ELSE CAST(trunc(100000 * greatest(0, least(1, {raw} * 0.5))) AS BIGINT) END AS size
        FROM kr""",
    )


@query("kelly_size", _kelly_sql("kelly_raw", ""))
def kelly_size(spark, sf):
    r = F.col("ret")
    raw = long_returns(spark, sf).withColumn("kelly_raw", sizing.kelly_raw(r, _KEYS))
    size = sizing.kelly_size(F.col("kelly_raw"), sizing.enough_history(r, _KEYS), 100000)
    return out(raw.withColumn("size", size), DAY, "kelly_raw", "size")


@query("kelly_continuous", _kelly_sql("cont_raw", ""))
def kelly_continuous(spark, sf):
    r = F.col("ret")
    raw = long_returns(spark, sf).withColumn("cont_raw", sizing.kelly_continuous_raw(r, _KEYS))
    size = sizing.kelly_size(F.col("cont_raw"), sizing.enough_history(r, _KEYS), 100000)
    return out(raw.withColumn("size", size), DAY, "cont_raw", "size")


_SIZE_VOL = full("stddev_samp", "ret", 15, 0, _DAYW)


@query(
    "size_factor",
    sql(
        "long_ret",
        f"""WITH {KELLY_CTES}, v AS (SELECT *, {_SIZE_VOL} AS vol FROM kr),
        s AS (SELECT *, CASE WHEN vol > 0 THEN least(0.5::DOUBLE / vol, 1) ELSE 1 END AS by_vol,
                     greatest(0, least(1, kelly_raw * 0.5)) AS by_kelly FROM v)
        SELECT symbol, day, round(by_vol, 6) AS vol_target,
               round(CASE WHEN seen >= 30 THEN by_kelly ELSE 0.5 END, 6) AS kelly,
               round(CASE WHEN seen >= 30 THEN 0.5 * by_kelly + 0.5 * by_vol ELSE by_vol END, 6) AS kelly_vol_blend
        FROM s""",
    ),
)
def size_factor(spark, sf):
    r = F.col("ret")
    days = long_returns(spark, sf).withColumns(
        {
            "vol": sizing.rolling_vol(r, _KEYS, 15),
            "raw": sizing.kelly_raw(r, _KEYS),
            "enough": sizing.enough_history(r, _KEYS),
        }
    )
    kinds = ("vol_target", "kelly", "kelly_vol_blend")
    cols = {k: sizing.size_factor(k, F.col("vol"), 0.5, F.col("raw"), F.col("enough")) for k in kinds}
    return out(days.withColumns(cols), DAY, *kinds)


@query(
    "decision_mask",
    sql(
        "bars_5m",
        f"""WITH s AS (SELECT *, row_number() OVER ({WD}) - 1 AS k,
               coalesce(nth_value(min_from_open, 2) OVER v - first_value(min_from_open) OVER v, 1) AS spacing
               FROM bars_5m WINDOW v AS ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT symbol, ts, CAST(k % greatest(1, 30 // spacing) = 0 AS INTEGER) AS decision FROM s""",
    ),
)
def decision_mask(spark, sf):
    masked = pos.decision_mask(fx.bars(spark, sf, 5), 30)
    return masked.select(*BAR, F.col("decision").cast("int").alias("decision"))


@query(
    "forward_label",
    sql(
        "ticks",
        f"""SELECT event_id, symbol, CAST(coalesce(lead(close, 5) OVER ({WS}) / close - 1 > 0.001, FALSE) AS INTEGER) AS label
        FROM ticks""",
    ),
)
def forward_label(spark, sf):
    ticks, layout = fx.cut(fx.ticks(spark, sf))
    return feat.forward_label(ticks, 5, layout=layout).select("event_id", "symbol", "label")


@query(
    "temporal_split",
    sql(
        "ticks",
        f"""SELECT event_id, symbol, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train'
               WHEN i < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'test' ELSE 'valid' END AS split
        FROM (SELECT *, row_number() OVER ({WS}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)""",
    ),
)
def temporal_split(spark, sf):
    ticks, layout = fx.cut(fx.ticks(spark, sf))
    return feat.temporal_split(ticks, layout=layout).select("event_id", "symbol", "split")


@query(
    "benchmark_equity",
    day_sql(f"round(100000 * product(1 + coalesce(ret, 0)) OVER ({_DAYW} ROWS UNBOUNDED PRECEDING), 4) AS equity", "daily_ret"),
)
def benchmark_equity(spark, sf):
    return out(m.with_equity(daily_returns(spark, sf), ["symbol"], start=100000.0), DAY, "equity", digits=4)
