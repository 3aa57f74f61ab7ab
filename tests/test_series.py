"""Blocks and chunks must not show in the results, however small they are."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import positions as pos
from barloom.operators.features import forward_label, impute_fill, temporal_split
from barloom.operators.selection import drop_warmup, slice_rows
from barloom.operators.series import BARS, Layout, Scan, blocked_scan
from barloom.sources import calendar

TINY = Layout(rows=7)
START = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rows():
    """One series holds most of the rows; gaps leave some days short and some empty."""
    rng = random.Random(5)
    out = []
    for symbol, n in (("hot", 400), ("cold", 30), ("one", 1)):
        price, ts = 100.0, START
        for _ in range(n):
            ts += dt.timedelta(minutes=rng.choice([5, 30, 240, 1500]))
            price = max(1.0, price + rng.choice([-2.0, -0.5, 0.0, 0.5, 1.5]))
            out.append((symbol, ts, price, float(rng.randrange(5)), rng.choice([None, -1.0, 2.0, 5.0])))
    return pd.DataFrame(out, columns=["symbol", "ts", "close", "volume", "x"])


@pytest.fixture(scope="module")
def bars(spark, rows):
    schema = "symbol string, ts timestamp_ntz, close double, volume double, x double"
    data = [tuple(None if v != v else v for v in r) for r in rows.astype(object).itertuples(index=False)]
    df = spark.createDataFrame([(r[0], r[1].to_pydatetime(), *r[2:]) for r in data], schema)
    return df.withColumn("day", F.to_date("ts")).withColumns({c: F.col("close") for c in ("open", "high", "low")}).cache()


def pull(df, *cols):
    return df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def same(a, b, *cols):
    for c in cols:
        left, right = a[c].astype(float).reset_index(drop=True), b[c].astype(float).reset_index(drop=True)
        pd.testing.assert_series_equal(left, right, check_names=False, rtol=1e-9, atol=1e-9)


def by_symbol(rows, fn):
    ordered = rows.sort_values(["symbol", "ts"])
    return pd.concat([fn(g) for _, g in ordered.groupby("symbol", sort=True)])


def test_running_operators_match_plain_pandas(bars, rows):
    scans = [
        Scan("total", "sum", F.col("close")),
        Scan("peak", "max", F.col("close")),
        Scan("filled", "last", F.col("x")),
        Scan("back", "next", F.col("x")),
    ]
    got = pull(blocked_scan(bars, scans), "total", "peak", "filled", "back")
    want = by_symbol(
        rows,
        lambda g: pd.DataFrame(
            {"total": g.close.cumsum(), "peak": g.close.cummax(), "filled": g.x.ffill(), "back": g.x.bfill()}
        ),
    )
    same(got, want, "total", "peak", "filled", "back")


def test_previous_row_across_blocks(bars, rows):
    got = pull(pos.previous(bars, BARS, v=F.col("close")).withColumn("v", F.col("_prev.v")), "v")
    same(got, by_symbol(rows, lambda g: pd.DataFrame({"v": g.close.shift()})), "v")


def test_ema_and_macd_in_tiny_chunks(bars, rows):
    got = pull(ind.ema(bars, (5, 20), TINY), "ema_5", "ema_20")
    ewm = lambda x, n: x.ewm(span=n, adjust=False).mean()
    same(got, by_symbol(rows, lambda g: pd.DataFrame({f"ema_{n}": ewm(g.close, n) for n in (5, 20)})), "ema_5", "ema_20")
    got = pull(ind.macd_hist(bars, {"m": (12, 26, 9)}, TINY), "m")

    def hist(g):
        line = ewm(g.close, 12) - ewm(g.close, 26)
        return pd.DataFrame({"m": line - ewm(line, 9)})

    same(got, by_symbol(rows, hist), "m")


def test_rolling_windows_in_tiny_chunks(bars, rows):
    got = pull(ind.sma(ind.rolling_std(bars, (5, 20), TINY), (5, 20), TINY), "vol_5", "vol_20", "ma_20")
    want = by_symbol(
        rows,
        lambda g: pd.DataFrame(
            {"vol_5": g.close.rolling(5).std(), "vol_20": g.close.rolling(20).std(), "ma_20": g.close.rolling(20).mean()}
        ),
    )
    same(got, want, "vol_5", "vol_20", "ma_20")


def test_wilder_rsi_in_tiny_chunks(bars, rows):
    def rsi(g, p=14):
        d = g.close.diff().tolist()
        out, up, down = [None] * len(d), None, None
        for i in range(len(d)):
            if i == p:
                up = sum(max(x, 0) for x in d[1 : p + 1]) / p
                down = sum(max(-x, 0) for x in d[1 : p + 1]) / p
            elif i > p:
                up, down = (up * (p - 1) + max(d[i], 0)) / p, (down * (p - 1) + max(-d[i], 0)) / p
            if i >= p:
                out[i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        return pd.DataFrame({"rsi": out}, index=g.index)

    same(pull(ind.rsi_wilder(bars, 14, layout=TINY), "rsi"), by_symbol(rows, rsi), "rsi")


def test_labels_and_slices_in_tiny_chunks(bars, rows):
    got = pull(forward_label(bars, 3, 0.001, layout=TINY), "label")
    want = by_symbol(rows, lambda g: pd.DataFrame({"label": (g.close.shift(-3) / g.close - 1 > 0.001).astype(int)}))
    same(got, want, "label")
    assert slice_rows(bars, -10, -2).groupBy("symbol").count().toPandas().set_index("symbol")["count"].to_dict() == {
        "hot": 8,
        "cold": 8,
    }
    kept = drop_warmup(bars, 60).groupBy("symbol").count().toPandas().set_index("symbol")["count"].to_dict()
    assert kept == {"hot": 340, "cold": 30, "one": 1}
    split = temporal_split(bars).where("symbol = 'hot'").groupBy("split").count().toPandas()
    assert split.set_index("split")["count"].to_dict() == {"train": 240, "test": 80, "valid": 80}
    with pytest.raises(ValueError):
        temporal_split(bars, 0.9, 0.9, 0.9)


def test_fill_ends_with_zero(bars):
    empty = impute_fill(bars.withColumn("x", F.lit(None).cast("double")), ["x"])
    assert empty.where("x <> 0").count() == 0


def loop_positions(g, k):
    """The order rule as a loop: orders of a decision bar execute at the next one of the same day."""
    out, held = [], 0
    days = sorted(g.ts.dt.date.unique())
    for day in days:
        pending = None
        for n, (_, r) in enumerate(g[g.ts.dt.date == day].iterrows()):
            if n % k == 0:
                if pending is not None:
                    held, pending = (1 if pending == 1 else 0), None
                if day != days[0] and ((r.signal == 1 and held == 0) or (r.signal == -1 and held == 1)):
                    pending = r.signal
            out.append(held)
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_latch_and_runs_match_a_loop(bars, rows, k):
    signal = F.when(F.col("x") == 2, 1).when(F.col("x") == -1, -1).otherwise(0)
    latched = pos.latch_position(pos.every_kth(bars.withColumn("signal", signal), k))
    got = pull(pos.runs(latched), "position", "run_id", "entry_price")

    def want(g):
        g = g.assign(signal=g.x.map({2.0: 1, -1.0: -1}).fillna(0))
        p = loop_positions(g, k)
        ids, prices, nth, entry, was = [], [], 0, None, 0
        for held, close in zip(p, g.close):
            if held and not was:
                nth, entry = nth + 1, close
            ids.append(nth if held else None)
            prices.append(entry if held else None)
            was = held
        return pd.DataFrame({"position": p, "run_id": ids, "entry_price": prices}, index=g.index)

    same(got, by_symbol(rows, want), "position", "run_id", "entry_price")


def test_barriers_match_a_loop(bars, rows):
    signal = F.when(F.col("x") == 2, 1).when(F.col("x") == -1, -1).otherwise(0)
    held = pos.runs(pos.latch_position(pos.every_kth(bars.withColumn("signal", signal), 1)))
    start = pull(held, "position", "run_id", "entry_price", "close")
    got = pull(pos.barrier_exit(held, 0.02, 0.03), "position", "exit_reason")
    out, dead, was, symbol = [], None, 0, None
    for r in start.itertuples():
        if r.symbol != symbol:
            symbol, dead, was = r.symbol, None, 0
        why, now = 0, 0
        if r.position == 1 and r.run_id != dead:
            pnl = r.close / r.entry_price - 1
            hit = 2 if (r.close - r.entry_price) / r.entry_price <= -0.02 else 3 if (r.close - r.entry_price) / r.entry_price >= 0.03 else 0
            if hit:
                dead, why = r.run_id, hit if was else 0
            else:
                now = 1
        elif was and r.position == 0:
            why = 1
        out.append((now, why))
        was = now
    same(got, pd.DataFrame(out, columns=["position", "exit_reason"]), "position", "exit_reason")


def _held_prices():
    """Moves, then long flat stretches, one of them after gains only."""
    rng = np.random.default_rng(8)
    moves = lambda n: (100 + rng.normal(0, 1, n).cumsum()).tolist()
    a = moves(40)
    a += [a[-1]] * 2600 + moves(30)
    a += [a[-1]] * 900 + [a[-1] + i for i in range(1, 4)] + [a[-1] + 3] * 700
    b = [50.0] * 30 + [51.0] * 1500 + [52.0, 51.5] + [51.5] * 20
    return {"a": a, "b": b}


def _rsi_loops(close, period):
    d = np.diff(close)
    gain, loss = np.where(d > 0, d, 0.0), np.where(d < 0, -d, 0.0)
    wilder, ewm = [None] * len(close), [None] * len(close)
    up, down = gain[:period].mean(), loss[:period].mean()
    g = f = 0.0
    fell = False
    for i in range(1, len(close)):
        c = (period - 1) / period
        g, f = c * g + gain[i - 1], c * f + loss[i - 1]
        fell = fell or loss[i - 1] > 0
        if i > period:
            up, down = c * up + gain[i - 1] / period, c * down + loss[i - 1] / period
        if i >= period:
            wilder[i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            ewm[i] = None if not fell else 100.0 if f == 0 else 100 - 100 / (1 + g / f)
    return wilder, ewm


def test_rsi_after_flat_stretches(spark):
    series = _held_prices()
    start = pd.Timestamp("2024-01-01 00:00")
    rows = [(s, start + pd.Timedelta(minutes=i), c) for s, v in series.items() for i, c in enumerate(v)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "close"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = df.withColumn("day", F.to_date("ts"))
    got = ind.rsi_ewm(ind.rsi_wilder(df, 14, "w"), (14,)).orderBy("ts").toPandas()
    for s, close in series.items():
        own = got[got.symbol == s]
        wilder, ewm = _rsi_loops(close, 14)
        assert np.allclose(own["w"].astype(float), np.array(wilder, float), atol=1e-6, equal_nan=True)
        assert np.allclose(own["rsi_14"].astype(float), np.array(ewm, float), atol=1e-6, equal_nan=True)


def test_unlike_coefficients_share_a_call(spark):
    close = _held_prices()["a"][:900]
    start = pd.Timestamp("2024-01-01")
    rows = [("a", start + pd.Timedelta(minutes=i), c) for i, c in enumerate(close)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "close"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = ind.ema(df.withColumn("day", F.to_date("ts")), (2, 5, 200)).orderBy("ts").toPandas()
    for span in (2, 5, 200):
        assert np.allclose(got[f"ema_{span}"], pd.Series(close).ewm(span=span, adjust=False).mean(), atol=1e-9)


@pytest.mark.parametrize(
    "year,off,early",
    [
        (2019, "01-01 01-21 02-18 04-19 05-27 07-04 09-02 11-28 12-25", "07-03 11-29 12-24"),
        (2020, "01-01 01-20 02-17 04-10 05-25 07-03 09-07 11-26 12-25", "11-27 12-24"),
        (2021, "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24", "11-26"),
        (2022, "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26", "11-25"),
        (2023, "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 12-25", "07-03 11-24"),
        (2025, "01-01 01-09 01-20 02-17 04-18 05-26 06-19 07-04 09-01 11-27 12-25", "07-03 11-28 12-24"),
        (2026, "01-01 01-19 02-16 04-03 05-25 06-19 07-03 09-07 11-26 12-25", "11-27 12-24"),
    ],
)
def test_market_calendar(spark, year, off, early):
    days = lambda df: " ".join(sorted(f"{r.day:%m-%d}" for r in df.collect()))
    assert days(calendar.holidays(spark, years=(year, year))) == off
    assert days(calendar.early_closes(spark, years=(year, year))) == early
