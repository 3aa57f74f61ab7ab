"""Sweeps: buckets, what barriers look at, sessions, models, and the re-run of the best."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import intraday
from barloom.plans import sweep as sw
from barloom.plans.grids import ParamGrid, strategy_grid
from barloom.session import materialize
from barloom.sources import calendar
from barloom.workload import fixtures as fx
from barloom.workload import sweeps as queries

SMALL = "/root/testdata/sf0.001"
GRID = ParamGrid(
    {"zscore_lookback": [3], "n_std_upper": [0.5, 1.0], "n_std_lower": [0.5, 1.0], "exit_threshold": [0.0, 0.5], "stop_loss_pct": [0.002, 0.01], "take_profit_pct": [0.01]}
)


@pytest.fixture(scope="module")
def reversion(spark):
    bars, signal, keep = sw.mean_reversion_inputs(fx.bars(spark, SMALL, 60, calm=True), [3])
    return bars.cache(), intraday.daily_vol(fx.daily(spark, SMALL, True)).cache(), GRID, signal, keep


def rows(df):
    return sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("barriers", [True, False])
def test_buckets_do_not_show(reversion, barriers):
    whole = rows(sw.sweep_days(*reversion, barriers=barriers))
    assert len({r[0] for r in whole} | {r[2] for r in whole}) > GRID.size // 2
    for size in (1, 3, 5, 16):
        assert rows(sw.sweep_days(*reversion, barriers=barriers, size=size)) == whole


@pytest.mark.parametrize("size", [3, 512])
@pytest.mark.parametrize("stops", [True, False])
def test_multiplied_rows_are_not_shuffled(reversion, size, stops):
    bars, daily, grid, signal, keep = reversion
    base = sw.dealt(sw.prepare(bars, daily, keep), grid, size)
    plan = sw.unit_returns(base, grid, signal, 0.0, stops, size=size)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(plan):
        if "Generate explode" not in line or "config" not in line and "_starts" not in line:
            continue
        # upwards from the explosion: an aggregate comes before any exchange
        level = depth(line)
        for above in reversed(plan[:at]):
            if depth(above) < level:
                level = depth(above)
                assert "Exchange" not in above
                if "Aggregate" in above:
                    break
        else:
            pytest.fail("no aggregate above the explosion")
    dealt = [line for line in plan if "Exchange hashpartitioning" in line and "bucket" in line and "config_id" not in line]
    assert bool(dealt) == (size == 3)


def test_only_the_best_are_run_again(reversion):
    bars, daily, grid, signal, keep = reversion
    days = sw.sweep_days(bars, daily, grid, signal, keep)
    results = materialize(sw.report(days, grid))
    again = sw.rerun_best(results, "sharpe_ratio", bars, daily, grid, signal, keep)
    best = {(r.symbol, r.config_id) for r in sw.best_configs(results).collect()}
    own = days.columns
    want = [tuple(r) for r in days.select(own).collect() if (r.symbol, r.config_id) in best]
    assert sorted(map(str, want)) == sorted(map(str, map(tuple, again.select(own).collect())))
    plan = again._jdf.queryExecution().toString()
    assert "explode(_ids" in plan and "sequence(" not in plan


def test_names_are_those_of_the_strategy(reversion):
    bars, daily, _, signal, keep = reversion
    with pytest.raises(ValueError, match="band_mult"):
        sw.sweep(bars, daily, ParamGrid({"band_mult": [1.0]}), signal, keep, strategy="mean_reversion")
    with pytest.raises(ValueError, match="model"):
        strategy_grid("momentum", model=["a"])
    with pytest.raises(ValueError, match="not scored"):
        sw.supervised_inputs(bars, ["a"])


def walk(days, stop, target, held=None):
    """A bar at a time: orders execute at the next bar of the day, one trade a run, barriers on the spread at entry."""
    out, position, entry, ordered, last = {}, 0, None, 0, None
    for n, (day, bars) in enumerate(days):
        told, gain, counts = None, 1.0, dict.fromkeys(("buys", "sells", "stop_losses", "take_profits"), 0)
        for close, spread, signal in bars:
            if n:
                was, want = position, ordered if told is None else told
                if want and not ordered:
                    position, entry = 1, spread
                elif not want:
                    position = 0
                ordered = want
                why = None
                if position and entry is not None and spread is not None and entry != 0:
                    move = (spread - entry) / abs(entry)
                    why = "stop_losses" if move <= -stop else "take_profits" if move >= target else None
                if why:
                    position = 0
                if was and not position and why:
                    counts[why] += 1
                counts["buys"] += position > was
                counts["sells"] += position < was
                gain *= 1 + was * (close / last - 1)
            told = {1: 1, -1: 0}.get(signal, told)
            last = close
        if n:
            out[day] = (round(gain - 1, 12), *counts.values(), position)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pair_barriers_look_at_the_spread(spark, seed):
    rng = random.Random(seed)
    a, b, table, days = 100.0, 90.0, [], []
    for d in range(12):
        own = []
        for i in range(rng.choice([4, 9, 15])):
            a, b = a * (1 + rng.choice([-0.01, 0.0, 0.012])), b * (1 + rng.choice([-0.01, 0.0, 0.01]))
            spread = None if rng.random() < 0.1 else a - b if rng.random() > 0.03 else 0.0
            own.append((a, spread, rng.choice([1, 1, -1, 0, 0])))
            table.append(("a/b", dt.date(2024, 3, 1 + d), dt.datetime(2024, 3, 1 + d, 10, i), 30 + i, *own[-1]))
        days.append((dt.date(2024, 3, 1 + d), own))
    bars = spark.createDataFrame(table, "symbol string, day date, ts timestamp_ntz, min_from_open int, close double, sp double, sig int")
    daily = bars.groupBy("symbol", "day").agg(F.min_by("close", "ts").alias("open"), F.max_by("close", "ts").alias("close"))
    grid = ParamGrid({"stop_loss_pct": [0.15, 0.4], "take_profit_pct": [0.2], "trade_freq": [1]})
    got, leg = {}, {}
    for name, gauge in (("spread", F.col("sp")), ("leg", None)):
        base = sw.dealt(sw.prepare(bars, daily, ["sp", "sig"]), grid, 1)
        found = sw.unit_returns(base, grid, F.col("sig"), 0.0, True, gauge, 1).collect()
        into = got if name == "spread" else leg
        for r in found:
            into[r.config_id, r.day] = (round(r.unit_ret, 12), r.buys, r.sells, r.stop_losses, r.take_profits, r.position)
    for config, stop in enumerate(grid.params["stop_loss_pct"]):
        for day, want in walk(days, stop, 0.2).items():
            assert got[config, day] == pytest.approx(want, abs=1e-9), (config, day)
    assert got != leg and sum(v[3] + v[4] for v in got.values()) > 0


def test_sessions_leave_out_days_and_late_bars(reversion, spark):
    bars, daily, grid, signal, keep = reversion
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("date").alias("day")
    closed = spark.range(1).select(day(9))
    early = spark.range(1).select(day(10), F.lit(13 * 60).alias("close_min")).unionByName(closed.withColumn("close_min", F.lit(0)))
    table = calendar.sessions(closed, early)
    assert sorted((str(r.day), r.closed, r.last_minute) for r in table.collect()) == [("2024-01-09", True, -570), ("2024-01-10", False, 210)]
    base = sw.prepare(bars, daily, [*keep, "min_from_open"], table)
    assert base.where("day = '2024-01-09'").count() == 0
    assert base.where("day = '2024-01-10'").agg(F.max("min_from_open")).first()[0] <= 210
    rest = [r for r in sw.sweep_days(bars, daily, grid, signal, keep, sessions=table).select("day").distinct().collect()]
    assert dt.date(2024, 1, 9) not in {r.day for r in rest} and len(rest) > 20
    # the day after starts from the last bar that was left in
    first = base.where("day = '2024-01-11' and bar = 0").select("symbol", "change", "close").collect()
    last = {r.symbol: r.close for r in bars.where("day = '2024-01-10' and min_from_open <= 210").groupBy("symbol").agg(F.max_by("close", "ts").alias("close")).collect()}
    assert first and all(r.change == pytest.approx(r.close / last[r.symbol] - 1) for r in first if r.symbol in last)


def test_default_queries_name_their_strategy():
    assert queries.GRID_PAIR.params["hedge_ratio"] == [1.0, 0.9]
