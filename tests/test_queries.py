"""Edge cases, exact ranks, plan shape, and registered queries against DuckDB."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.functions import signals as sig
from barloom.functions.numeric import clip, ratio
from barloom.operators import metrics as m
from barloom.operators.ranks import exact_quantiles, rank_auc
from barloom.operators.scaling import fit_scaler
from barloom.operators.selection import select_features
from barloom.plans import sweep as sw
from barloom.plans.grids import ParamGrid, default_config, strategy_grid, validate_config
from barloom.sources.bars import DAILY_BARS, conform
from barloom.workload import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def returns(spark, values, symbol="a"):
    rows = [(symbol, f"2024-01-{i + 1:02d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, day string, ret double")
    return df.withColumn("day", F.to_date("day"))


def one(df):
    return df.first().asDict()


def test_metric_edges(spark):
    r = F.col("ret")
    flat = returns(spark, [0.01] * 25)
    got = one(flat.groupBy("symbol").agg(m.sharpe(r).alias("s"), m.sortino(r).alias("d"), m.win_rate(r).alias("w")))
    assert got["s"] > 1e6 or got["s"] == 0.0
    assert got["d"] is None and got["w"] == 1.0
    short = one(returns(spark, [0.1]).groupBy("symbol").agg(m.sharpe(r).alias("s"), m.value_at_risk(r).alias("v")))
    assert short == {"symbol": "a", "s": None, "v": None} or (short["s"] is None and short["v"] is None)
    ruin = one(returns(spark, [0.5, -1.0, 0.5]).groupBy("symbol").agg(m.total_return(r).alias("t")))
    assert ruin["t"] == -1.0
    var = one(returns(spark, [i / 100 for i in range(-10, 10)]).groupBy("symbol").agg(m.value_at_risk(r).alias("v")))
    assert math.isclose(var["v"], 0.09)


def test_beta_of_a_series_with_itself(spark):
    df = returns(spark, [0.01, -0.02, 0.03, 0.0]).withColumn("ret_ticker", F.col("ret"))
    got = one(m.benchmark_all(df, ["symbol"]))
    assert math.isclose(got["beta"], 1.0) and math.isclose(got["correlation"], 1.0)
    assert got["information_ratio"] is None
    still = one(m.benchmark_all(df.withColumn("ret_ticker", F.lit(0.0)), ["symbol"]))
    assert still["beta"] is None and still["treynor_ratio"] is None


def test_best_row_breaks_ties_by_first_and_skips_missing(spark):
    rows = [("a", 1, None), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 4, None)]
    df = spark.createDataFrame(rows, "symbol string, config_id int, score double")
    best = {r["symbol"]: r["config_id"] for r in m.best_rows(df, "score", ["symbol"]).collect()}
    assert best == {"a": 2, "b": 4}


def test_exit_overrides_long_and_missing_holds(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, None), (3, None, None)], "k int, a boolean, b boolean")
    got = [r[0] for r in df.orderBy("k").select(sig.decide(F.col("a"), F.col("b"))).collect()]
    assert got == [-1, 1, 0]
    with pytest.raises(ValueError):
        sig.signal("no such signal")


def test_division_by_zero_is_missing(spark):
    got = spark.range(1).select(ratio(F.lit(1.0), F.lit(0.0)), clip(F.lit(None).cast("double"), 0, 1)).first()
    assert got[0] is None and got[1] is None


@pytest.mark.parametrize("blocks", [None, 5, 256, 5_000])
def test_exact_quantiles_and_auc_across_blocks(spark, blocks):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=700), np.zeros(400)])
    y = rng.integers(0, 2, size=x.size)
    pdf = pd.DataFrame({"x": x, "z": np.round(x, 1), "c": 1.0, "label": y})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["x", "z", "c"], [0.0, 0.25, 0.5, 0.95, 1.0], blocks=blocks).toPandas().set_index("feature")
    for c in ("x", "z", "c"):
        want = np.quantile(pdf[c], [0.0, 0.25, 0.5, 0.95, 1.0])
        np.testing.assert_allclose(got.loc[c, [f"q{i}" for i in range(5)]].astype(float), want, atol=1e-12)
    auc = rank_auc(df, ["x", "z", "c"], blocks=blocks).toPandas().set_index("feature")["auc"]
    for c in ("x", "z", "c"):
        pos, neg = pdf[c][y == 1].to_numpy(), pdf[c][y == 0].to_numpy()
        diff = pos[:, None] - neg[None, :]
        assert math.isclose(auc[c], ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size, rel_tol=1e-9)


def test_groups_are_ranked_together(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": np.round(rng.normal(size=900), 2), "label": rng.integers(0, 2, 900), "split": rng.choice(["a", "b"], 900)})
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr("barloom.operators.ranks.ROWS_PER_BLOCK", 40)
    got = rank_auc(df, ["x"], by=["split"]).toPandas().set_index("split")["auc"]
    alone = {s: rank_auc(df.where(F.col("split") == s), ["x"]).first().auc for s in ("a", "b")}
    assert got.to_dict() == pytest.approx(alone)
    q = exact_quantiles(df, ["x"], [0.3], by=["split"]).toPandas().set_index("split")["q0"]
    assert q.to_dict() == pytest.approx(pdf.groupby("split").x.quantile(0.3).to_dict())


def test_a_feature_that_turns_is_found(spark):
    from barloom.operators.selecting import feature_report, feature_score_binned

    rng = np.random.default_rng(5)
    n = 3_000
    u, line, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = ((np.abs(u) > 0.8) ^ (rng.random(n) < 0.1)).astype(int)
    line = line + y
    df = spark.createDataFrame(pd.DataFrame({"u": u, "line": line, "noise": noise, "flat": 1.0, "label": y}))
    names = ["u", "line", "noise", "flat"]
    by_rank = feature_report(df, names, min_variance=0.0, threshold=0.6).toPandas().set_index("feature")
    by_bins = feature_report(df, names, min_variance=0.0, threshold=0.6, score="binned").toPandas().set_index("feature")
    assert by_rank.selected.to_dict() == {"u": 0, "line": 1, "noise": 0, "flat": 0}
    assert by_bins.selected.to_dict() == {"u": 1, "line": 1, "noise": 0, "flat": 0}
    assert by_bins.score["u"] > 0.85 and abs(by_bins.score["noise"] - 0.5) < 0.05
    whole = feature_score_binned(df, names).toPandas().set_index("feature").score
    assert whole["flat"] == 0.5


def test_constant_columns_scale_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "c double")
    for kind in ("minmax", "standard", "robust"):
        assert [r["c"] for r in fit_scaler(df, ["c"], kind).transform(df).collect()] == [0.0, 0.0]


def test_schema_and_feature_errors(spark):
    df = spark.createDataFrame([(1.0,)], "open double")
    with pytest.raises(ValueError, match="missing"):
        conform(df, DAILY_BARS)
    with pytest.raises(ValueError, match="not available"):
        select_features(df, ["close"])


def test_grids(spark):
    grid = ParamGrid({"a": [1, 2], "b": [0.1, 0.2, 0.3]})
    rows = [(r.config_id, r.a, r.b) for r in grid.frame(spark).orderBy("config_id").collect()]
    assert rows == [(i * 3 + j, a, b) for i, a in enumerate([1, 2]) for j, b in enumerate([0.1, 0.2, 0.3])]
    assert strategy_grid("momentum").size == 4 * 4 * 3 * 3 * 3 * 3
    validate_config(default_config("mean_reversion"), "mean_reversion")
    with pytest.raises(ValueError):
        validate_config(default_config("supervised"), "supervised")


def test_multiplied_rows_are_not_shuffled(spark):
    """Between the explosion of configurations and the daily reduction there is no exchange."""
    bars = fx.bars(spark, SMALL, 60, calm=True)
    grid = ParamGrid({"zscore_lookback": [3], "n_std_upper": [1.0], "n_std_lower": [1.0, 2.0], "exit_threshold": [0.0]})
    ready, signal, keep = sw.mean_reversion_inputs(bars, [3])
    base = sw.dealt(sw.prepare(ready, fx.daily(spark, SMALL, calm=True), keep), grid)
    days = sw.unit_returns(base, grid, signal, 0.0, stops=False)
    plan = days._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate" in line)
    exchanges = [line for line in plan[:at] if "Exchange" in line]
    assert len(exchanges) == 1 and "config_id" in exchanges[0]
    reduced = next(i for i, line in enumerate(plan) if "HashAggregate" in line or "SortAggregate" in line or "ObjectHash" in line)
    assert plan.index(exchanges[0]) < reduced


@pytest.mark.parametrize(
    "name",
    ["filter_date_range", "resample_intraday", "metrics_all", "ema", "sig_probability", "barrier_exit", "sweep_momentum"],
)
def test_registered_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    rows = sorted(map(str, want.fetchall()))
    got = entry.queries()[name](spark, SMALL).select(*cols)
    assert sorted(str(tuple(r)) for r in got.collect()) == rows


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.count() == 5 and "sharpe_ratio" in got.columns


def test_unknown_parameters_are_an_error(spark):
    with pytest.raises(ValueError, match="max_drawdown_pct"):
        strategy_grid("momentum", max_drawdown_pct=[0.1])
    with pytest.raises(ValueError, match="no_such"):
        sw.sweep_days(None, None, ParamGrid({"band_mult": [1.0], "no_such": [1]}), None, [])


def test_csv_columns_are_found_in_each_file(spark, tmp_path):
    one, two = tmp_path / "symbol=A B" / "version=v1", tmp_path / "symbol=C" / "version=v1"
    one.mkdir(parents=True), two.mkdir(parents=True)
    (one / "x.csv").write_text(",caldt,volume,open,high,low,close\n0,2024-01-02,5,1,4,0.5,2\n1,2024-01-03,6,2,3,1,2\n")
    (two / "y.csv").write_text("volume,open,high,low,close,caldt\n7,10,40,5,20,2024-01-02\n")
    from barloom.sources import bars

    rows = bars.scan_bars(spark, str(tmp_path), fmt="csv").orderBy("symbol", "day").collect()
    assert [(r.symbol, str(r.day), r.open, r.close, r.volume) for r in rows] == [
        ("A B", "2024-01-02", 1.0, 2.0, 5.0),
        ("A B", "2024-01-03", 2.0, 2.0, 6.0),
        ("C", "2024-01-02", 10.0, 20.0, 7.0),
    ]


def test_keys_without_any_version_stay(spark):
    from barloom.sources.bars import latest_version

    df = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("b", "v1", 3), ("b", "v2", 4)], "symbol string, version string, x int")
    assert sorted(r.x for r in latest_version(df).collect()) == [1, 4]


def test_all_varied_features_are_scored(spark):
    from barloom.operators.selecting import feature_report

    rows = [(i % 2, *[float((i * (k + 3)) % 11) for k in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, f0 double, f1 double, f2 double, f3 double")
    names = ["f0", "f1", "f2", "f3"]
    assert feature_report(df, names).where("score is not null").count() == 4
    assert feature_report(df, names, max_features=2).where("score is not null").count() == 2


def test_kelly_history_follows_the_configuration(spark):
    grid = ParamGrid({"sizing_type": ["kelly"], "kelly_lookback": [3, 8], "kelly_min_trades": [2, 5]})
    rng = np.random.default_rng(1)
    start = pd.Timestamp("2024-01-01")
    unit = rng.normal(0, 0.01, 15)
    rows = [(c, "a", (start + pd.Timedelta(days=i)).date(), float(u), 0, 0, 0, 0) for c in range(4) for i, u in enumerate(unit)]
    days = spark.createDataFrame(rows, "config_id int, symbol string, day date, unit_ret double, buys long, sells long, stop_losses long, take_profits long")
    daily = days.where("config_id = 0").select("symbol", "day", F.lit(1.0).alias("close"))
    got = {}
    for r in sw.sized_days(days, grid, daily, None).orderBy("day").collect():
        got.setdefault(r.config_id, []).append(r.size_factor)
    for c, (lookback, least) in enumerate([(3, 2), (3, 5), (8, 2), (8, 5)]):
        for i in range(15):
            past = unit[max(0, i - lookback) : i]
            win, loss = past[past > 0], -past[past < 0]
            if i < least:
                want = 0.5
            elif not len(win):
                want = 0.0
            elif not len(loss):
                want = 0.5
            else:
                p = len(win) / len(past)
                want = min(max((p - (1 - p) / (win.mean() / loss.mean())) * 0.5, 0), 1)
            assert got[c][i] == pytest.approx(want, abs=1e-9)
