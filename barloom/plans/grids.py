"""Parameter grids. A grid is never joined: a row is multiplied by exploding a sequence of
configuration numbers, and the parameters are read off the number's mixed-radix digits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default grids, defaults and required parameters per strategy.
COMMON_GRID = {
    "trade_freq": [30, 45, 60, 90],
    "stop_loss_pct": [0.01, 0.02, 0.03],
    "take_profit_pct": [0.04, 0.05, 0.06],
    "drawdown_limit": [0.10, 0.15, 0.20],
    "target_vol": [0.015, 0.02, 0.025],
}
STRATEGY_GRIDS = {
    "momentum": {"band_mult": [0.8, 1.0, 1.2, 1.5]},
    "momentum_atr": {"atr_mult": [1.5, 2.0, 2.5, 3.0], "atr_period": [10, 14, 20]},
    "mean_reversion": {
        "zscore_lookback": [10, 20, 30],
        "n_std_upper": [1.5, 2.0, 2.5],
        "n_std_lower": [1.5, 2.0, 2.5],
        "exit_threshold": [0.0, 0.5],
    },
    "mean_reversion_rsi": {
        "rsi_period": [7, 10, 14],
        "rsi_oversold": [25.0, 30.0, 35.0],
        "rsi_overbought": [65.0, 70.0, 75.0],
        "sma_period": [100, 200],
    },
    "stat_arb": {
        "zscore_lookback": [30, 60, 90],
        "entry_threshold": [1.5, 2.0, 2.5],
        "exit_threshold": [0.0, 0.5],
        "use_dynamic_hedge": [True, False],
    },
    "supervised": {
        "buy_threshold": [0.50, 0.55, 0.60, 0.65],
        "sell_threshold": [0.35, 0.40, 0.45, 0.50],
    },
}
COMMON_DEFAULTS = {
    "capital": 100000.0,
    "commission": 0.0035,
    "trade_freq": 30,
    "sizing_type": "vol_target",
    "target_vol": 0.02,
    "kelly_fraction": 0.5,
    "kelly_lookback": 60,
    "kelly_min_trades": 30,
    "kelly_vol_blend_weight": 0.5,
    "max_leverage": 1.0,
    "stop_loss_pct": 0.02,
    "take_profit_pct": 0.04,
    "drawdown_limit": 0.15,
}
STRATEGY_DEFAULTS = {
    "momentum": {"band_mult": 1.0},
    "momentum_atr": {"atr_mult": 2.0, "atr_period": 14},
    "mean_reversion": {"zscore_lookback": 20, "n_std_upper": 2.0, "n_std_lower": 2.0, "exit_threshold": 0.0},
    "mean_reversion_rsi": {
        "rsi_period": 10,
        "rsi_oversold": 30.0,
        "rsi_overbought": 70.0,
        "sma_period": 200,
        "exit_on_sma_cross": True,
    },
    "stat_arb": {
        "zscore_lookback": 60,
        "entry_threshold": 2.0,
        "exit_threshold": 0.0,
        "use_dynamic_hedge": True,
        "hedge_ratio": None,
    },
    "supervised": {"buy_threshold": 0.55, "sell_threshold": 0.45, "model": None},
}
REQUIRED = {
    "momentum": ["band_mult"],
    "momentum_atr": ["atr_mult", "atr_period"],
    "mean_reversion": ["zscore_lookback", "n_std_upper", "n_std_lower"],
    "mean_reversion_rsi": ["rsi_period", "rsi_oversold", "rsi_overbought", "sma_period"],
    "stat_arb": ["zscore_lookback", "entry_threshold"],
    "supervised": ["model_path"],
}
REQUIRED_COMMON = ["capital", "trade_freq", "stop_loss_pct", "take_profit_pct"]


@dataclass(frozen=True)
class ParamGrid:
    """Cartesian product of parameter lists; the last parameter varies fastest."""

    params: Mapping[str, Sequence[Any]]

    @property
    def size(self) -> int:
        return math.prod(len(v) for v in self.params.values())

    def decode(self, config: Column) -> dict[str, Column]:
        out, stride = {}, self.size
        for name, values in self.params.items():
            stride //= len(values)
            digit = F.floor(config / stride) % len(values)
            out[name] = F.element_at(F.array(*[F.lit(v) for v in values]), digit.cast("int") + 1)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        ids = spark.range(self.size).select(F.col("id").cast("int").alias("config_id"))
        return ids.withColumns(self.decode(F.col("config_id")))

    def multiply(self, df: DataFrame) -> DataFrame:
        """Every row once per configuration. A narrow step: the partitioning of ``df`` survives."""
        ids = F.explode(F.sequence(F.lit(0), F.lit(self.size - 1)))
        return df.withColumn("config_id", ids).withColumns(self.decode(F.col("config_id")))

    def with_params(self, df: DataFrame) -> DataFrame:
        """Add the parameters to rows that carry a ``config_id``."""
        return df.withColumns(self.decode(F.col("config_id")))


def check_names(params: Mapping[str, Any], strategy: str | None = None) -> None:
    """Every name must be one that the strategy (or, without one, any strategy) or all of them know."""
    own = STRATEGY_DEFAULTS if strategy is None else {strategy: STRATEGY_DEFAULTS[strategy]}
    known = {*COMMON_DEFAULTS, *(name for defaults in own.values() for name in defaults)}
    unknown = sorted(set(params) - known)
    if unknown:
        raise ValueError(f"unknown parameters: {unknown}")


def strategy_grid(strategy: str, common: bool = True, **overrides: Sequence[Any]) -> ParamGrid:
    """Default grid of a strategy with some lists replaced."""
    if strategy not in STRATEGY_GRIDS:
        raise ValueError(f"unknown strategy {strategy!r}")
    check_names(overrides, strategy)
    return ParamGrid({**STRATEGY_GRIDS[strategy], **(COMMON_GRID if common else {}), **overrides})


def default_config(strategy: str, **overrides: Any) -> dict[str, Any]:
    return {"strategy": strategy, **COMMON_DEFAULTS, **STRATEGY_DEFAULTS[strategy], **overrides}


def validate_config(config: Mapping[str, Any], strategy: str) -> None:
    missing = [p for p in (*REQUIRED_COMMON, *REQUIRED[strategy]) if config.get(p) is None]
    if missing:
        raise ValueError(f"missing required parameters for {strategy}: {missing}")


def grid_sizes(symbols: DataFrame, common: bool = False) -> DataFrame:
    """Number of configurations per symbol and strategy."""
    rows = None
    for name in STRATEGY_GRIDS:
        ids = strategy_grid(name, common).multiply(symbols).select("symbol", F.lit(name).alias("strategy"))
        rows = ids if rows is None else rows.unionByName(ids)
    return rows.groupBy("symbol", "strategy").agg(F.count(F.lit(1)).alias("n_configs"))


def pick(prefix: str, param: Column | str, values: Sequence[Any]) -> Column:
    """The precomputed column ``prefix + value`` that matches the row's parameter."""
    p = F.col(param) if isinstance(param, str) else param
    out = F.when(p == values[0], F.col(f"{prefix}{values[0]}"))
    for v in values[1:]:
        out = out.when(p == v, F.col(f"{prefix}{v}"))
    return out
