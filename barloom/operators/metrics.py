"""Return, risk and benchmark metrics of daily return series.

Input rows are one per (group, day): ``ret`` and, where needed, ``rf_daily``, ``ret_ticker`` and
``equity``. Their number per group is bounded by the calendar, which is what makes the running
maximum and the sorted array behind VaR safe. Everything else combines map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.numeric import ratio, rnd
from barloom.functions.risk import drawdown

YEAR = 252
MIN_OBS = 20
_ROOT = math.sqrt(YEAR)


def growth(r: Column) -> Column:
    """Product of 1 + r over the known returns."""
    return F.product(1 + r)


def total_return(r: Column) -> Column:
    return growth(r) - 1


def annualized_return(r: Column) -> Column:
    n = F.count(r)
    return F.when(n > 0, F.pow(growth(r), ratio(F.lit(float(YEAR)), n.cast("double"))) - 1)


def volatility(r: Column, annualize: bool = False, population: bool = False) -> Column:
    sd = F.stddev_pop(r) if population else F.stddev_samp(r)
    return sd * _ROOT if annualize else sd


def value_at_risk(r: Column, confidence: float = 0.95) -> Column:
    """Historical VaR: the return at position int((1 - confidence) * n) of the sorted series, negated."""
    n = F.count(r)
    at = (F.lit(1.0 - confidence) * n).cast("int") + 1
    return F.when(n >= 2, -F.try_element_at(F.sort_array(F.collect_list(r)), at))


def sharpe(x: Column, annualize: bool = True) -> Column:
    n, sd = F.count(x), F.stddev_samp(x)
    value = ratio(F.avg(x), sd) * (_ROOT if annualize else 1.0)
    return F.when(n >= MIN_OBS, F.when(sd > 0, value).otherwise(F.lit(0.0)))


def sortino(x: Column, annualize: bool = True) -> Column:
    n = F.count(x)
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    value = ratio(F.avg(x), down) * (_ROOT if annualize else 1.0)
    return F.when((n >= MIN_OBS) & (down > 0), value)


def calmar(r: Column, dd: Column) -> Column:
    n, worst = F.count(r), F.min(dd)
    return F.when(n >= 2, ratio(annualized_return(r), F.abs(worst)))


def win_rate(r: Column) -> Column:
    return F.coalesce(F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))), F.lit(0.0))


def excess(ret: Column | str = "ret", rf: Column | str = "rf_daily") -> Column:
    r = F.col(ret) if isinstance(ret, str) else ret
    f = F.col(rf) if isinstance(rf, str) else rf
    return r - f


def with_equity(df: DataFrame, keys: Sequence[str], ret="ret", out="equity", start: float = 1.0) -> DataFrame:
    """Running product of 1 + ret; missing returns count as 0."""
    w = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, start * F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))


def with_drawdown(df: DataFrame, keys: Sequence[str], equity="equity", out="drawdown") -> DataFrame:
    w = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, drawdown(F.col(equity), F.max(equity).over(w)))


def max_drawdown(df: DataFrame, keys: Sequence[str], equity="equity") -> DataFrame:
    """0 for fewer than two points."""
    return (
        with_drawdown(df, keys, equity)
        .groupBy(*keys)
        .agg(F.when(F.count(equity) >= 2, F.least(F.min("drawdown"), F.lit(0.0))).otherwise(0.0).alias("max_drawdown"))
    )


def return_metrics(ret: Column, ex: Column, dd: Column) -> dict[str, Column]:
    return {
        "total_return": total_return(ret),
        "annualized_return": annualized_return(ret),
        "annualized_volatility": volatility(ret, annualize=True),
        "sharpe_ratio": sharpe(ex),
        "sortino_ratio": sortino(ex),
        "calmar_ratio": calmar(ret, dd),
        "max_drawdown": F.min(dd),
        "win_rate": win_rate(ret),
        "var_95": value_at_risk(ret, 0.95),
        "var_99": value_at_risk(ret, 0.99),
    }


def metrics_all(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ten return metrics in one pass; expects ret, rf_daily and equity."""
    cols = return_metrics(F.col("ret"), excess(), F.col("drawdown"))
    return with_drawdown(df, keys).groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])


def beta(r: Column, b: Column) -> Column:
    return ratio(F.covar_samp(r, b), F.var_samp(F.when(r.isNotNull(), b)))


def alpha(r: Column, b: Column, rf_annual: Column | float = 0.0) -> Column:
    rf = (rf_annual if isinstance(rf_annual, Column) else F.lit(float(rf_annual))) / YEAR
    return ((F.avg(r) - rf) - beta(r, b) * (F.avg(b) - rf)) * YEAR


def correlation(r: Column, b: Column) -> Column:
    """NULL where one side does not vary."""
    return ratio(F.covar_samp(r, b), F.stddev_samp(r) * F.stddev_samp(b))


def information_ratio(r: Column, b: Column) -> Column:
    active = r - b
    return ratio(F.avg(active) * YEAR, F.stddev_samp(active) * _ROOT)


def treynor(r: Column, b: Column, rf_annual: Column | float = 0.0) -> Column:
    rf = rf_annual if isinstance(rf_annual, Column) else F.lit(float(rf_annual))
    return ratio(F.avg(r) * YEAR - rf, beta(r, b))


def benchmark_metrics(r: Column, b: Column, rf_annual: Column | float = 0.0) -> dict[str, Column]:
    return {
        "beta": beta(r, b),
        "alpha": alpha(r, b, rf_annual),
        "correlation": correlation(r, b),
        "r_squared": correlation(r, b) * correlation(r, b),
        "information_ratio": information_ratio(r, b),
        "treynor_ratio": treynor(r, b, rf_annual),
    }


def benchmark_all(df: DataFrame, keys: Sequence[str], rf_annual: float = 0.0) -> DataFrame:
    """The six benchmark metrics over aligned days; NULL with fewer than two of them."""
    both = df.where(F.col("ret").isNotNull() & F.col("ret_ticker").isNotNull())
    cols = benchmark_metrics(F.col("ret"), F.col("ret_ticker"), rf_annual)
    return both.groupBy(*keys).agg(*[F.when(F.count(F.lit(1)) >= 2, c).alias(n) for n, c in cols.items()])


def strategy_report(
    df: DataFrame, keys: Sequence[str], rf_annual: float = 0.0, extra: dict[str, Column] | None = None
) -> DataFrame:
    """One statistics row per group with its buy-and-hold twin, rounded as reported.

    Expects one row per day with ret, ret_ticker and rf_daily; ``extra`` adds aggregates.
    """
    with_both = with_equity(with_equity(df, keys), keys, "ret_ticker", "equity_ticker")
    ready = with_drawdown(with_drawdown(with_both, keys), keys, "equity_ticker", "drawdown_ticker")
    r, b = F.col("ret"), F.col("ret_ticker")
    own = return_metrics(r, excess(), F.col("drawdown"))
    hold = return_metrics(b, excess("ret_ticker"), F.col("drawdown_ticker"))
    both = r.isNotNull() & b.isNotNull()
    pair = benchmark_metrics(F.when(both, r), F.when(both, b), rf_annual)
    pct = lambda c, d=2: rnd(c * 100, d)
    return ready.groupBy(*keys).agg(
        F.count("ret").alias("n_days"),
        pct(own["total_return"]).alias("total_return_pct"),
        pct(own["annualized_return"]).alias("annualized_return_pct"),
        pct(own["win_rate"]).alias("win_rate_pct"),
        pct(own["max_drawdown"]).alias("max_drawdown_pct"),
        pct(own["annualized_volatility"]).alias("annualized_volatility_pct"),
        rnd(own["sharpe_ratio"], 4).alias("sharpe_ratio"),
        rnd(own["sortino_ratio"], 4).alias("sortino_ratio"),
        rnd(own["calmar_ratio"], 4).alias("calmar_ratio"),
        pct(hold["total_return"]).alias("hold_return_pct"),
        pct(hold["annualized_return"]).alias("hold_annualized_return_pct"),
        pct(hold["max_drawdown"]).alias("hold_max_drawdown_pct"),
        pct(hold["annualized_volatility"]).alias("hold_volatility_pct"),
        rnd(hold["sharpe_ratio"], 4).alias("hold_sharpe_ratio"),
        rnd(hold["sortino_ratio"], 4).alias("hold_sortino_ratio"),
        rnd(hold["calmar_ratio"], 4).alias("hold_calmar_ratio"),
        rnd(pair["beta"], 4).alias("beta"),
        pct(pair["alpha"], 4).alias("alpha_pct"),
        rnd(pair["correlation"], 4).alias("correlation"),
        rnd(pair["r_squared"], 4).alias("r_squared"),
        rnd(pair["information_ratio"], 4).alias("information_ratio"),
        rnd(pair["treynor_ratio"], 4).alias("treynor_ratio"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def best_rows(df: DataFrame, metric: str, by: Sequence[str], tie: str = "config_id", ascending=False) -> DataFrame:
    """The row with the best metric per group; missing metrics lose, the first row wins ties.

    An arg-max aggregate, so a hot group is reduced map-side instead of being sorted in one task.
    """
    score = -F.col(metric) if ascending else F.col(metric)
    rank = F.struct(score.isNotNull().alias("known"), score.alias("score"), (-F.col(tie)).alias("tie"))
    row = F.max_by(F.struct(*df.columns), rank).alias("_row")
    return df.groupBy(*by).agg(row).select("_row.*")


def sweep_summary(df: DataFrame, by=("symbol",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_configs"),
        F.min("sharpe_ratio").alias("min_sharpe"),
        F.max("sharpe_ratio").alias("max_sharpe"),
        F.min("total_return_pct").alias("min_return_pct"),
        F.max("total_return_pct").alias("max_return_pct"),
    )


def excess_vs_hold(df: DataFrame) -> DataFrame:
    return df.withColumn("excess_return_pct", F.col("total_return_pct") - F.col("hold_return_pct"))
