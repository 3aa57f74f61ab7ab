"""Days of ticks that are cut into blocks give what whole days give."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.functions.numeric import bisect
from barloom.operators import indicators as ind
from barloom.operators.series import BARS, DAY, Scan, blocked_scan, cut_blocks
from barloom.workload import fixtures as fx

TICKS = "/root/testdata/sf0.01"
QUERIES = [
    "day_columns_ticks", "slice_rows", "drawdown_series", "impute_fill", "forward_label", "temporal_split",
    "sig_probability", "sig_probability_daily_reset", "sig_prediction", "rsi_ewm_ticks", "risk_predicates",
]


@pytest.fixture(scope="module")
def expected():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{TICKS}/events.parquet')")
    out = {}
    for name in QUERIES:
        rows = con.execute(entry.oracle_sql()[name])
        out[name] = [d[0] for d in rows.description], sorted(rows.fetchall(), key=str)
    return out


@pytest.mark.parametrize("target", [7, 50])
@pytest.mark.parametrize("name", QUERIES)
def test_tick_queries_at_any_target(spark, monkeypatch, expected, name, target):
    monkeypatch.setattr(fx, "TICK_BLOCK", target)
    cols, want = expected[name]
    got = entry.queries()[name](spark, TICKS).select(*cols)
    got = sorted(map(tuple, got.collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        # sums in another order may round the last digit the other way
        assert all(abs(x - y) <= 2e-6 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def ticks_of_one_day(spark, n, seconds):
    start = dt.datetime(2024, 3, 1, 9)
    rows = [("hot", start + dt.timedelta(seconds=i % seconds, microseconds=i // seconds), float(i % 11)) for i in range(n)]
    rows += [("cold", start, 1.0), (None, start, 2.0)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").withColumn("day", F.to_date("ts"))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_blocks_are_ranges_of_about_the_target(spark, monkeypatch, broadcast):
    monkeypatch.setattr("barloom.operators.series.BOUNDS_BROADCAST", broadcast)
    df, layout = cut_blocks(ticks_of_one_day(spark, 3_000, 600), BARS, 50)
    assert layout.block == "_block" and layout.keys == ("symbol",)
    rows = df.where("symbol = 'hot'").groupBy("_block").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    rows = rows.orderBy("_block").collect()
    assert len(rows) == 60 and all(r.n <= 55 for r in rows)
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
    # a second is never cut, and short days stay as they are
    whole, _ = cut_blocks(ticks_of_one_day(spark, 500, 1), DAY, 50)
    assert whole.where("symbol = 'hot'").select("day").count() == 500
    same, layout = cut_blocks(ticks_of_one_day(spark, 40, 40), DAY, 50)
    assert layout is DAY and "_block" not in same.columns
    assert cut_blocks(same.limit(0), DAY, 1)[1] is DAY


def test_no_window_over_a_whole_day_of_ticks(spark):
    df, layout = cut_blocks(ticks_of_one_day(spark, 3_000, 600), DAY, 50)
    scan = blocked_scan(df, [Scan("peak", "max", F.col("close"))], layout)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or "+- Window [" in line]
    assert windows and all("_block" in line for line in windows)
    assert scan.groupBy("symbol").agg(F.max("peak").alias("p")).where("symbol = 'hot'").first().p == 10.0


def test_bisect(spark):
    bounds = list(range(0, 200, 3))
    df = spark.range(-2, 210).withColumn("b", F.array(*map(F.lit, bounds))).withColumn("none", F.lit(None).cast("array<int>"))
    rows = df.select("id", bisect("b", "id", 67).alias("n"), bisect("b", "id", 67, True).alias("m"), bisect("none", "id", 67).alias("z")).collect()
    assert all(r.n == sum(b <= r.id for b in bounds) and r.m == sum(b < r.id for b in bounds) and r.z == 0 for r in rows)


def test_rsi_reads_its_input_as_often_as_an_average(spark):
    """The rows under an RSI are computed once: what is scanned afterwards is the written table."""
    bars = spark.read.parquet(f"{TICKS}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.to_date("ts").alias("day"), F.col("value").alias("close"))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    rsi = ind.rsi_ewm(bars, (5, 14))
    assert scans(rsi) <= scans(ind.ema(bars))
    assert rsi._jdf.queryExecution().executedPlan().toString().count("Exchange") < 8
