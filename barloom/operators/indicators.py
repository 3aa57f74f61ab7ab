"""Indicators over the bars of a series.

Every public function takes a frame and a ``Layout``: ``BARS`` runs over the whole series of a
symbol (chunked), ``DAY`` restarts with every day, which is how strategies evaluate them.
The ``*_stage`` builders return plain Columns and compose: ``features.feature_matrix`` runs all of
them over a single chunking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.numeric import ratio
from barloom.functions.risk import drawdown
from barloom.operators import recurrence as rec
from barloom.operators.recurrence import Recurrence
from barloom.operators.series import BARS, DAY, Frame, Layout, Scan, Stage, blocked_scan, over_chunks
from barloom.session import materialize

WINDOWS = (5, 10, 20, 30, 50, 60)
EMA_SPANS = (5, 10, 20, 60)
RSI_PERIODS = (5, 10, 14, 26)
MACD = {"macd_normal": (12, 26, 9), "macd_short": (10, 50, 5)}
RISK_WINDOW = 20


def when_full(value: Column, seen: Column, n: int) -> Column:
    return F.when(seen >= n, value)


# ---------------------------------------------------------------- plain frames


def lag_stage(f: Frame) -> dict[str, Column]:
    return {f"prev_{c}": F.lag(c, 1).over(f.rows) for c in ("open", "high", "low", "close", "volume")}


def std_stage(windows: Sequence[int]) -> Stage:
    return lambda f: {
        f"vol_{n}": when_full(F.stddev_samp("close").over(f.last(n)), f.seen("close", n), n)
        for n in windows
    }


def sma_stage(windows: Sequence[int], source: str = "close", prefix: str = "ma_") -> Stage:
    return lambda f: {
        f"{prefix}{n}": when_full(F.avg(source).over(f.last(n)), f.seen(source, n), n)
        for n in windows
    }


def log_return_stage(f: Frame) -> dict[str, Column]:
    out = {}
    for c in ("open", "high", "low", "close"):
        safe = F.nullif(F.col(c), F.lit(0.0))
        out[f"lr_{c}"] = F.coalesce(F.ln(safe) - F.lag(F.ln(safe)).over(f.rows), F.lit(0.0))
    out["r_volume"] = F.coalesce(F.col("volume") - F.lag("volume").over(f.rows), F.lit(0.0))
    return out


def zscore_stage(windows: Sequence[int]) -> Stage:
    def stage(f: Frame) -> dict[str, Column]:
        out = {}
        for n in windows:
            z = ratio(F.col("close") - F.avg("close").over(f.last(n)), F.stddev_samp("close").over(f.last(n)))
            out[f"zscore_{n}"] = when_full(z, f.seen("close", n), n)
        return out

    return stage


def zscore_lagged_stage(lookbacks: Sequence[int], source: str = "close", prefix: str = "z_") -> Stage:
    """Score against mean and population deviation of the rows before the current one."""

    def stage(f: Frame) -> dict[str, Column]:
        out = {}
        for n in lookbacks:
            w = f.last(n, skip=1)
            z = ratio(F.col(source) - F.avg(source).over(w), F.stddev_pop(source).over(w))
            out[f"{prefix}{n}"] = when_full(z, f.seen(source, n, 1), n)
        return out

    return stage


def sma_lagged_stage(periods: Sequence[int], source: str = "close", prefix: str = "sma_") -> Stage:
    return lambda f: {
        f"{prefix}{n}": when_full(
            F.avg(source).over(f.last(n, skip=1)), f.seen(source, n, 1), n
        )
        for n in periods
    }


def momentum_stage(lags: Sequence[int] = (1, 5, 10)) -> Stage:
    return lambda f: {f"momentum_{n}": ratio("close", F.lag("close", n).over(f.rows)) - 1 for n in lags}


def volume_stage(with_vwap: bool) -> Stage:
    def stage(f: Frame) -> dict[str, Column]:
        w = f.last(RISK_WINDOW)
        avg = when_full(F.avg("volume").over(w), f.seen("volume", RISK_WINDOW), RISK_WINDOW)
        out = {"volume_ma_20": avg, "volume_ratio": ratio("volume", avg)}
        if with_vwap:
            out["vwap_deviation"] = ratio(F.col("close") - F.col("vwap"), "vwap")
        return out

    return stage


def risk_stages() -> list[Stage]:
    def returns(f: Frame) -> dict[str, Column]:
        return {"_ret": ratio("close", F.lag("close").over(f.rows)) - 1}

    def ratios(f: Frame) -> dict[str, Column]:
        w = f.last(RISK_WINDOW)
        full = F.count("_ret").over(w)
        mean = F.avg("_ret").over(w)
        down = F.stddev_samp(F.when(F.col("_ret") > 0, 0.0).otherwise(F.col("_ret"))).over(w)
        return {
            "rolling_sharpe": when_full(ratio(mean, F.stddev_samp("_ret").over(w)), full, RISK_WINDOW),
            "rolling_sortino": when_full(ratio(mean, down), full, RISK_WINDOW),
        }

    return [returns, ratios]


def _framed(df: DataFrame, stages: Sequence[Stage], before: int, layout: Layout) -> DataFrame:
    return over_chunks(df, stages, layout, before=before)


def lags(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    return _framed(df, [lag_stage], 1, layout)


def rolling_std(df: DataFrame, windows: Sequence[int] = WINDOWS, layout: Layout = BARS) -> DataFrame:
    return _framed(df, [std_stage(windows)], max(windows), layout)


def sma(df: DataFrame, windows: Sequence[int] = WINDOWS, layout: Layout = BARS) -> DataFrame:
    return _framed(df, [sma_stage(windows)], max(windows), layout)


def log_returns(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    return _framed(df, [log_return_stage], 1, layout)


def zscore_incl(df: DataFrame, windows: Sequence[int] = (20, 30), layout: Layout = BARS) -> DataFrame:
    return _framed(df, [zscore_stage(windows)], max(windows), layout)


def zscore_lagged(df: DataFrame, lookbacks: Sequence[int], layout: Layout = BARS) -> DataFrame:
    return _framed(df, [zscore_lagged_stage(lookbacks)], max(lookbacks) + 1, layout)


def sma_lagged(df: DataFrame, periods: Sequence[int], layout: Layout = BARS) -> DataFrame:
    return _framed(df, [sma_lagged_stage(periods)], max(periods) + 1, layout)


def momentum(df: DataFrame, steps: Sequence[int] = (1, 5, 10), layout: Layout = BARS) -> DataFrame:
    return _framed(df, [momentum_stage(steps)], max(steps), layout)


def volume_features(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    return _framed(df, [volume_stage("vwap" in df.columns)], RISK_WINDOW, layout)


def rolling_risk(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    return _framed(df, risk_stages(), RISK_WINDOW + 1, layout)


def drawdown_series(df: DataFrame, source: str = "close", layout: Layout = BARS) -> DataFrame:
    """Distance from the running maximum of the series."""
    peaks = blocked_scan(df, [Scan("_peak", "max", F.col(source))], layout)
    return peaks.withColumn("drawdown", drawdown(F.col(source), F.col("_peak"))).drop("_peak")


# ---------------------------------------------------------------- recurrences


def _ema_parts(spans: Sequence[int], source: str, prefix: str):
    recs = [Recurrence(f"{prefix}{s}", rec.ema_coef(s), f"_b_{prefix}{s}") for s in spans]

    def inputs(f: Frame) -> dict[str, Column]:
        return {f"_b_{prefix}{s}": rec.ema_input(F.col(source), s, f) for s in spans}

    return inputs, recs


def ema(df: DataFrame, spans: Sequence[int] = EMA_SPANS, layout: Layout = BARS) -> DataFrame:
    """Exponential averages seeded with the first value."""
    inputs, recs = _ema_parts(spans, "close", "ema_")
    step = rec.common_step(*[r.c for r in recs])
    return over_chunks(df, [inputs, *rec.stages(recs)], layout, before=rec.halo(step), step=step)


def ema_sma_seed(df: DataFrame, period: int, out: str = "ema", layout: Layout = BARS) -> DataFrame:
    """Exponential average seeded with the plain mean of the first ``period`` values."""
    c = rec.ema_coef(period)
    r = Recurrence(out, c, "_b", start=period - 1)
    step = rec.common_step(c)
    inputs = lambda f: {"_b": rec.seeded_input(F.col("close"), period, c, f)}
    return over_chunks(df, [inputs, *rec.stages([r])], layout, before=rec.halo(step) + period, step=step)


def _change(f: Frame) -> dict[str, Column]:
    return {"_d": F.col("close") - F.lag("close").over(f.rows)}


def _gain() -> Column:
    return F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0)


def _loss() -> Column:
    return F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)


def _rsi_parts(periods: Sequence[int]):
    recs, inputs = [], {}
    for p in periods:
        for side, value in (("g", _gain()), ("l", _loss())):
            recs.append(Recurrence(f"_{side}{p}", rec.wilder_coef(p), f"_b{side}"))
            inputs[f"_b{side}"] = value

    def result(f: Frame) -> dict[str, Column]:
        out = {"fell__": F.when(F.col("_d") < 0, 1)}
        for p in periods:
            up, down = F.col(f"_g{p}"), F.col(f"_l{p}")
            value = F.when((down == 0) & (up > 0), F.lit(ALL_GAIN)).otherwise(100 - 100 / (1 + ratio(up, down)))
            out[f"rsi_{p}"] = F.when((f.i == p) | (f.i > p) & _moved(), value)
        return out

    return [_change, lambda f: inputs], recs, result


# Stands for gains without a loss in reach until it is known if there was one before.
ALL_GAIN = -1.0


def _moved() -> Column:
    return F.coalesce(F.col("_d") != 0, F.lit(False))


def settled(held: Column) -> Column:
    """An RSI carried forward, once it is known (``ever__``) whether the series has fallen before."""
    return F.when(held == ALL_GAIN, F.when(F.col("ever__") == 1, F.lit(100.0))).otherwise(held)


def ever_fell() -> Scan:
    return Scan("ever__", "max", F.col("fell__"))


def held_ratio(df: DataFrame, columns: Sequence[str], layout: Layout = BARS) -> DataFrame:
    """Carry the last value of RSI columns over rows without a price change, and say what gains without a loss mean.

    Both averages decay alike while the price stands still, so their ratio does not move however long that takes.
    Losses that have decayed away leave an RSI of 100; where there never was one it has no value. Over blocks the rows
    are read twice, so the averages are written in between.
    """
    fell = "fell__" in df.columns
    ready = materialize(df) if layout.block else df
    scans = [Scan(f"{c}__", "last", F.col(c)) for c in columns]
    out = blocked_scan(ready, [*scans, *([ever_fell()] if fell else [])], layout)
    out = out.withColumns({c: settled(F.col(f"{c}__")) if fell else F.col(f"{c}__") for c in columns})
    return out.drop("fell__", "ever__", *[f"{c}__" for c in columns])


def rsi_ewm(df: DataFrame, periods: Sequence[int] = RSI_PERIODS, layout: Layout = BARS) -> DataFrame:
    """RSI from bias-corrected exponential averages. The correction is the same for gains and
    losses, so it cancels in their ratio and plain decayed sums suffice."""
    first, recs, result = _rsi_parts(periods)
    step = rec.common_step(*[r.c for r in recs])
    stages = [*first, *rec.stages(recs), result]
    rows = over_chunks(df, stages, layout, before=rec.halo(step) + 1, step=step)
    return held_ratio(rows, [f"rsi_{p}" for p in periods], layout)


def rsi_wilder_stages(period: int, out: str) -> tuple[list[Stage], list[Recurrence]]:
    """Wilder's RSI where the price moves; 100 while there has been no loss. ``held_ratio`` fills the other rows."""
    c = rec.wilder_coef(period)
    recs = [Recurrence(f"_wg{period}", c, f"_bg{period}", start=period), Recurrence(f"_wl{period}", c, f"_bl{period}", start=period)]

    def sides(f: Frame) -> dict[str, Column]:
        return {"_gain": F.when(f.i > 0, _gain()), "_fall": F.when(f.i > 0, _loss())}

    def inputs(f: Frame) -> dict[str, Column]:
        return {
            f"_bg{period}": rec.seeded_input(F.col("_gain"), period, c, f, first=1),
            f"_bl{period}": rec.seeded_input(F.col("_fall"), period, c, f, first=1),
        }

    def result(f: Frame) -> dict[str, Column]:
        up, down = F.col(f"_wg{period}"), F.col(f"_wl{period}")
        value = F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + ratio(up, down)))
        return {out: F.when((f.i == period) | (f.i > period) & _moved(), value)}

    return [_change, sides, inputs, *rec.stages(recs), result], recs


def rsi_wilder(df: DataFrame, period: int = 14, out: str = "rsi", layout: Layout = BARS) -> DataFrame:
    stages, recs = rsi_wilder_stages(period, out)
    step = rec.common_step(recs[0].c)
    return held_ratio(over_chunks(df, stages, layout, before=rec.halo(step) + period + 1, step=step), [out], layout)


def _macd_parts(configs: dict[str, tuple[int, int, int]]):
    spans = sorted({s for fast, slow, _ in configs.values() for s in (fast, slow)})
    inputs, recs = _ema_parts(spans, "close", "_m")

    def line(f: Frame) -> dict[str, Column]:
        out = {}
        for name, (fast, slow, sig) in configs.items():
            value = F.col(f"_m{fast}") - F.col(f"_m{slow}")
            out[f"_line_{name}"] = value
            out[f"_bl_{name}"] = rec.ema_input(value, sig, f)
        return out

    signals = [Recurrence(f"_sig_{n}", rec.ema_coef(cfg[2]), f"_bl_{n}") for n, cfg in configs.items()]
    result = lambda f: {n: F.col(f"_line_{n}") - F.col(f"_sig_{n}") for n in configs}
    return inputs, recs, line, signals, result


def macd_hist(df: DataFrame, configs: dict[str, tuple[int, int, int]] = MACD, layout: Layout = BARS) -> DataFrame:
    inputs, recs, line, signals, result = _macd_parts(configs)
    step = rec.common_step(*[r.c for r in (*recs, *signals)])
    stages = [inputs, *rec.stages(recs), line, *rec.stages(signals), result]
    return over_chunks(df, stages, layout, before=rec.halo(step, 2), step=step)


def smoothing_stages() -> tuple[list[Stage], int]:
    """EMA, RSI and MACD of the feature matrix: two rounds of recurrences for all of them."""
    ema_in, ema_recs = _ema_parts(EMA_SPANS, "close", "ema_")
    rsi_in, rsi_recs, rsi_out = _rsi_parts(RSI_PERIODS)
    macd_in, macd_recs, line, signals, macd_out = _macd_parts(MACD)
    recs = [*ema_recs, *rsi_recs, *macd_recs]
    step = rec.common_step(*[r.c for r in (*recs, *signals)])
    stages = [ema_in, *rsi_in, macd_in, *rec.stages(recs), rsi_out, line, *rec.stages(signals), macd_out]
    return stages, step


# ---------------------------------------------------------------- volatility bands, per day


def true_range_stage(f: Frame) -> dict[str, Column]:
    prev = F.lag("close").over(f.rows)
    spread = F.col("high") - F.col("low")
    return {"true_range": F.greatest(spread, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))}


def true_range(df: DataFrame, layout: Layout = DAY) -> DataFrame:
    return over_chunks(df, [true_range_stage], layout, before=1)


def atr_stages(periods: Sequence[int]) -> tuple[list[Stage], int]:
    recs = [Recurrence(f"atr_{p}", rec.wilder_coef(p), f"_batr{p}", start=p - 1) for p in periods]
    inputs = lambda f: {
        f"_batr{p}": rec.seeded_input(F.col("true_range"), p, rec.wilder_coef(p), f) for p in periods
    }
    return [true_range_stage, inputs, *rec.stages(recs)], rec.common_step(*[r.c for r in recs])


def atr(df: DataFrame, periods: Sequence[int] = (14,), layout: Layout = DAY) -> DataFrame:
    stages, step = atr_stages(periods)
    return over_chunks(df, stages, layout, before=rec.halo(step) + max(periods) + 1, step=step)


def atr_bands(df: DataFrame, mult, atr: str = "atr_14", ref_high="ref_high", ref_low="ref_low") -> DataFrame:
    return df.withColumns(
        {"upper_band": F.col(ref_high) + mult * F.col(atr), "lower_band": F.col(ref_low) - mult * F.col(atr)}
    )


def range_stage(lookback: int) -> Stage:
    """Highest high and lowest low of up to ``lookback`` earlier bars."""
    return lambda f: {
        "_hi": F.max("high").over(f.rows.rowsBetween(-lookback, -1)),
        "_lo": F.min("low").over(f.rows.rowsBetween(-lookback, -1)),
    }


BAND_BUFFER = 0.1


def trailing_atr_bands(
    df: DataFrame, mult: float = 2.0, period: int = 14, lookback: int = 20, layout: Layout = DAY
) -> DataFrame:
    stages, step = atr_stages([period])

    def bands(f: Frame) -> dict[str, Column]:
        pad = F.lit(mult) * F.col(f"atr_{period}") * BAND_BUFFER
        return {"upper_band": F.col("_hi") + pad, "lower_band": F.col("_lo") - pad}

    return over_chunks(
        df,
        [*stages, range_stage(lookback), bands],
        layout,
        before=max(rec.halo(step) + period + 1, lookback),
        step=step,
    )


def keltner_bands(
    df: DataFrame, mult: float = 2.0, period: int = 14, ema_period: int = 20, layout: Layout = DAY
) -> DataFrame:
    """SMA-seeded exponential average plus and minus a multiple of the ATR."""
    c = rec.ema_coef(ema_period)
    stages, step_atr = atr_stages([period])
    mid = Recurrence("mid_band", c, "_bmid", start=ema_period - 1)
    step = max(step_atr, rec.common_step(c))
    centre = lambda f: {"_bmid": rec.seeded_input(F.col("close"), ema_period, c, f)}

    def bands(f: Frame) -> dict[str, Column]:
        pad = F.lit(mult) * F.col(f"atr_{period}")
        return {"upper_band": F.col("mid_band") + pad, "lower_band": F.col("mid_band") - pad}

    before = rec.halo(step) + max(period, ema_period) + 1
    return over_chunks(df, [*stages, centre, *rec.stages([mid]), bands], layout, before=before, step=step)


# ---------------------------------------------------------------- pairs


def pair_stages(lookback: int, hedge: float | None = None, suffix: str = "") -> list[Stage]:
    """Hedge ratio (ratio of lagged means, or fixed), spread and its lagged score."""
    h, s, z = f"hedge_ratio{suffix}", f"spread{suffix}", f"spread_z{suffix}"

    def ratio_of_means(f: Frame) -> dict[str, Column]:
        if hedge is not None:
            return {h: F.lit(float(hedge))}
        w = f.last(lookback, skip=1)
        mean_b = F.avg("close_b").over(w)
        value = F.when(mean_b > 0, F.avg("close_a").over(w) / F.nullif(mean_b, F.lit(0.0))).otherwise(F.lit(1.0))
        return {h: when_full(value, F.count("close_b").over(w), lookback)}

    def spread(f: Frame) -> dict[str, Column]:
        return {s: F.col("close_a") - F.col(h) * F.col("close_b")}

    def score(f: Frame) -> dict[str, Column]:
        w = f.last(lookback, skip=1)
        value = ratio(F.col(s) - F.avg(s).over(w), F.stddev_pop(s).over(w))
        return {z: when_full(value, F.count(s).over(w), lookback)}

    return [ratio_of_means, spread, score]


def pair_spread(df: DataFrame, lookback: int, hedge: float | None = None, layout: Layout = BARS) -> DataFrame:
    return over_chunks(df, pair_stages(lookback, hedge), layout, before=2 * lookback + 1)
