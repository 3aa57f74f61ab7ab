"""Sources and sinks. What is scanned here is first written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.session import scratch_folder
from barloom.sources import bars as src
from barloom.sources import artefacts, calendar, catalogue, rates, results, vendor
from barloom.workload import fixtures as fx
from barloom.workload.aggregates import daily_returns
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import DAY, out

OHLCV = ("open", "high", "low", "close", "volume")
OLD, NEW = "20240201_090000", "20240301_101500"


def _snapshots(spark, sf, fmt="parquet"):
    """Two versions of the daily bars: the first half of the month, then all of it."""
    root = scratch_folder(spark, "bars")
    days = fx.daily(spark, sf).select("symbol", "day", *OHLCV)
    src.sink_bars(days.where(F.dayofmonth("day") <= 15), root, OLD, fmt)
    src.sink_bars(days, root, NEW, fmt)
    return root


@query(
    "scan_bars",
    sql(
        "daily",
        f"""SELECT 'v{OLD}' AS version, symbol, day, open, high, low, close, volume FROM daily WHERE day(day) <= 15
        UNION ALL SELECT 'v{NEW}', symbol, day, open, high, low, close, volume FROM daily""",
    ),
)
def scan_bars(spark, sf):
    return src.scan_bars(spark, _snapshots(spark, sf, "csv"), fmt="csv").select("version", *DAY, *OHLCV)


@query("latest_version", sql("daily", "SELECT symbol, day, close FROM daily"))
def latest_version(spark, sf):
    return src.latest_version(src.scan_bars(spark, _snapshots(spark, sf))).select("symbol", "day", "close")


@query(
    "latest_version_by_path",
    sql("daily", "SELECT symbol, TIMESTAMP '2024-03-01 10:15:00' AS written, count(*) AS n FROM daily GROUP BY 1"),
)
def latest_version_by_path(spark, sf):
    """The version read off the file path."""
    files = spark.read.parquet(_snapshots(spark, sf))
    dated = files.select("symbol", src.file_version(F.col("_metadata.file_path")).alias("written"))
    newest = src.latest_version(dated, version="written")
    return newest.groupBy("symbol", "written").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_inventory",
    sql(
        "daily",
        f"""SELECT symbol, 'v{OLD}' AS version, count(*) AS n_rows, min(day) AS first, max(day) AS last
        FROM daily WHERE day(day) <= 15 GROUP BY 1
        UNION ALL SELECT symbol, 'v{NEW}', count(*), min(day), max(day) FROM daily GROUP BY 1""",
    ),
)
def snapshot_inventory(spark, sf):
    return src.snapshot_inventory(src.scan_bars(spark, _snapshots(spark, sf)))


@query("sink_bars", sql("daily", "SELECT symbol, day, open, high, low, close, volume FROM daily"))
def sink_bars(spark, sf):
    root = scratch_folder(spark, "sink")
    src.sink_bars(fx.daily(spark, sf).select("symbol", "day", *OHLCV), root, NEW)
    return src.scan_bars(spark, root).select(*DAY, *OHLCV)


@query(
    "schema_contract",
    sql(
        "ticks",
        """SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE volume = 0) AS n_incomplete,
               CAST(count(*) >= 100 AS INTEGER) AS long_enough FROM ticks GROUP BY 1""",
    ),
)
def schema_contract(spark, sf):
    """Upper-case vendor names, and NaN where nothing was traded."""
    ticks = fx.ticks(spark, sf).withColumn(
        "volume", F.when(F.col("volume") == 0, F.lit(float("nan"))).otherwise(F.col("volume"))
    )
    vendor_names = ticks.select("symbol", F.col("ts").alias("Datetime"), *[F.col(c).alias(c.upper()) for c in OHLCV])
    return src.schema_contract(vendor_names, src.INTRADAY, 100)


def _pages(spark, sf):
    """Fifty ticks to a page."""
    ticks = fx.ticks(spark, sf)
    millis = (F.col("epoch") * 1000).cast("bigint")
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    bar = F.struct(
        millis.alias("t"),
        F.col("volume").alias("v"),
        F.col("open").alias("o"),
        F.col("high").alias("h"),
        F.col("low").alias("l"),
        F.col("close").alias("c"),
    )
    return (
        ticks.withColumn("epoch", epoch)
        .groupBy("symbol", F.floor(F.col("event_id") / 50).alias("page_no"))
        .agg(F.to_json(F.struct(F.collect_list(bar).alias("results"))).alias("page"))
    )


@query(
    "vendor_json_bars",
    sql(
        "ticks",
        """SELECT symbol, date_trunc('second', ts) - INTERVAL 5 HOUR AS ts, close, volume FROM ticks
        WHERE CAST(date_trunc('second', ts) - INTERVAL 5 HOUR AS TIME) BETWEEN TIME '09:30:00' AND TIME '15:59:00'""",
    ),
)
def vendor_json_bars(spark, sf):
    return vendor.bars_from_pages(_pages(spark, sf)).select("symbol", "ts", "close", "volume")


@query("vendor_json_dividends", sql("dividends", "SELECT symbol, day, dividend FROM dividends"))
def vendor_json_dividends(spark, sf):
    row = F.struct(F.col("day").cast("string").alias("ex_dividend_date"), F.col("dividend").alias("cash_amount"))
    pages = (
        fx.dividends(spark, sf)
        .groupBy("symbol", F.weekofyear("day").alias("week"))
        .agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("page"))
    )
    return vendor.dividends_from_pages(pages)


@query("wide_to_long", sql("daily", "SELECT symbol, day, open, high, low, close, volume FROM daily"))
def wide_to_long(spark, sf):
    days = fx.daily(spark, sf)
    # a wide file has a column per symbol, so the names are read before it can be built
    types = sorted(r.symbol for r in days.select("symbol").distinct().collect())
    cells = [
        F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}|{f.title()}") for s in types for f in OHLCV
    ]
    return src.wide_to_long(days.groupBy("day").agg(*cells)).select(*DAY, *OHLCV)


@query(
    "scan_risk_free",
    sql(
        "risk_free",
        "SELECT 'auto' AS kind, day, round(rate, 9) AS rate FROM risk_free UNION ALL SELECT 'decimal', day, round(rate, 9) FROM risk_free",
    ),
)
def scan_risk_free(spark, sf):
    decimal = fx.risk_free(spark, sf)
    percent = decimal.withColumn("rate", F.col("rate") * 100)
    parts = [
        rates.decimal_rates(percent).withColumn("kind", F.lit("auto")),
        rates.decimal_rates(decimal).withColumn("kind", F.lit("decimal")),
    ]
    return parts[0].unionByName(parts[1]).select("kind", "day", F.round("rate", 9).alias("rate"))


@query(
    "calendar_dims",
    sql(
        "ticks",
        """SELECT day, CAST(day IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-01-09') AS INTEGER) AS holiday,
               CASE WHEN day = DATE '2024-01-10' THEN 780 END AS close_min FROM (SELECT DISTINCT day FROM ticks)""",
    ),
)
def calendar_dims(spark, sf):
    """The days of the data against the calendar with one added holiday and one added early close."""
    days = fx.days_of(spark, sf)
    off = calendar.holidays(spark, ["2024-01-09"]).withColumn("holiday", F.lit(1))
    early = calendar.early_closes(spark, ["2024-01-10"])
    return days.join(off, "day", "left").join(early, "day", "left").na.fill(0, ["holiday"])


@query(
    "sink_results",
    sql(
        "daily_ret",
        """SELECT 'buy_hold' AS strategy, symbol, day, round(ret, 6) + 0 AS ret, '{"size":1.0,"freq":30}' AS config FROM daily_ret""",
    ),
)
def sink_results(spark, sf):
    root = scratch_folder(spark, "results")
    days = daily_returns(spark, sf).select("symbol", "day", "ret")
    results.sink_results(days, root, "portfolio", "buy_hold", {"size": 1.0, "freq": 30})
    back = results.load_results(spark, root, "portfolio", "buy_hold")
    return out(back, ("strategy", *DAY, "config"), "ret")


# ------------------------------------------------------------------ snapshots by file name


def _named(spark, sf, root, kind, name, days, symbols):
    """One CSV snapshot per symbol, named as vendors' files are."""
    for s in symbols:
        own = days.where(F.col("symbol") == s).drop("symbol").coalesce(1)
        own.write.option("header", True).csv(f"{root}/{kind}/{s.upper()}/{s.upper()}_{kind}_{name}.csv")


def _symbols(days):
    """A file is written per symbol, so the names are read first."""
    return sorted(r.symbol for r in days.select("symbol").distinct().collect())


_LATEST = "SELECT upper(symbol) AS symbol, day, open, high, low, close, volume FROM daily"


@query("scan_latest_unstamped", sql("daily", _LATEST))
def scan_latest_unstamped(spark, sf):
    """Names without a time: the file that was changed last counts."""
    root, days = scratch_folder(spark, "named"), fx.daily(spark, sf).select("symbol", "day", *OHLCV)
    names = _symbols(days)
    _named(spark, sf, root, "daily", "feed_a", days.where(F.dayofmonth("day") <= 15), names)
    _named(spark, sf, root, "daily", "feed", days, names)
    return catalogue.scan_latest(spark, root, "daily")


@query("scan_latest_mixed_kinds", sql("daily bars_1h", f"SELECT 'daily' AS kind, count(*) AS n, sum(volume) AS volume FROM daily UNION ALL SELECT 'intraday', count(*), sum(volume) FROM bars_1h"))
def scan_latest_mixed_kinds(spark, sf):
    """Daily and intraday snapshots side by side, old and new ones; the time in the name decides, whatever was written last."""
    root, days = scratch_folder(spark, "named"), fx.daily(spark, sf).select("symbol", "day", *OHLCV)
    names, hours = _symbols(days), fx.bars(spark, sf).select("symbol", "ts", *OHLCV)
    _named(spark, sf, root, "daily", NEW, days, names)
    _named(spark, sf, root, "daily", OLD, days.where(F.dayofmonth("day") <= 15), names)
    _named(spark, sf, root, "intraday", OLD, hours, names)
    both = [catalogue.scan_latest(spark, root, kind).select("volume", F.lit(kind).alias("kind")) for kind in ("daily", "intraday")]
    return both[0].unionByName(both[1]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("snapshot_catalogue", sql("daily", f"SELECT upper(symbol) AS symbol, 'daily' AS kind, TIMESTAMP '2024-03-01 10:15:00' AS stamp, 2 AS snapshots FROM daily GROUP BY 1"))
def snapshot_catalogue(spark, sf):
    """Newest stamp and number of snapshots of each symbol, from the listing alone."""
    root, days = scratch_folder(spark, "named"), fx.daily(spark, sf).select("symbol", "day", *OHLCV)
    names = _symbols(days)
    for stamp in (NEW, OLD):
        _named(spark, sf, root, "daily", stamp, days.where(F.dayofmonth("day") <= 3), names)
    files = catalogue.catalogue(spark, root)
    return files.groupBy("symbol", "kind").agg(F.max("stamp").alias("stamp"), F.countDistinct("snapshot").cast("int").alias("snapshots"))


@query("wide_three_row_header", sql("daily", "SELECT symbol, day, open, high, low, close, volume FROM daily"))
def wide_three_row_header(spark, sf):
    """Two wide files with unlike symbols, three header lines each."""
    days, root = fx.daily(spark, sf), scratch_folder(spark, "wide")
    names = _symbols(days)
    for i, own in enumerate((names[:2], names[2:])):
        cells = [F.max(F.when(F.col("symbol") == s, F.col(f))).cast("string").alias(f"c{j}") for j, (s, f) in enumerate((s, f) for s in own for f in OHLCV)]
        lines = [["Ticker", *(s for s in own for _ in OHLCV)], ["Price", *(f.title() for _ in own for f in OHLCV)], ["Date", *([None] * len(cells))]]
        body = days.where(F.col("symbol").isin(own)).groupBy(F.col("day").cast("string").alias("day")).agg(*cells)
        head = spark.createDataFrame([(n, *line) for n, line in enumerate(lines)], ", ".join(["n int", "day string", *(f"c{j} string" for j in range(len(cells)))]))
        whole = head.unionByName(body.withColumn("n", F.lit(3))).coalesce(1).sortWithinPartitions("n", "day").drop("n")
        whole.write.csv(f"{root}/file{i}")
    return src.scan_wide(spark, root, src.DAILY_BARS[0]).select(*DAY, *OHLCV)


@query(
    "scan_risk_free_file",
    sql("risk_free", "SELECT kind, day, round(rate, 9) AS rate FROM risk_free, (VALUES ('percent'), ('decimal')) t(kind)"),
)
def scan_risk_free_file(spark, sf):
    """One file in percent, one in decimals, read together."""
    root, decimal = scratch_folder(spark, "rates"), fx.risk_free(spark, sf)
    for kind, factor in (("percent", 100), ("decimal", 1)):
        out_ = decimal.select(F.col("day").cast("string").alias("date"), (F.col("rate") * factor).alias("rate")).coalesce(1)
        out_.write.option("header", True).csv(f"{root}/{kind}")
    read = rates.scan_rates(spark, [f"{root}/percent", f"{root}/decimal"])
    kind = F.element_at(F.split("file", "/"), -2)
    return read.select(kind.alias("kind"), "day", F.round("rate", 9).alias("rate"))


@query(
    "results_latest",
    sql("daily_ret", "SELECT 'buy_hold' AS strategy, symbol, day, round(ret, 6) + 0 AS ret, TIMESTAMP '2024-03-01 10:15:00' AS stamp, TIMESTAMP '2024-02-01 09:00:00' AS best_stamp FROM daily_ret"),
)
def results_latest(spark, sf):
    """Two versions of a portfolio: the newest is read back; the older one has the better metric."""
    root, days = scratch_folder(spark, "results"), daily_returns(spark, sf).select("symbol", "day", "ret")
    for stamp, share, metric in ((NEW, 1.0, 0.5), (OLD, 0.5, 0.9)):
        results.publish_results(days.withColumn("ret", F.col("ret") * share), root, "portfolio", "buy_hold", stamp, {"size": share}, metric)
    newest = artefacts.latest(spark, root, "portfolio").select(F.col("key").alias("strategy"), "stamp")
    best = artefacts.best(spark, root, "portfolio").select(F.col("key").alias("strategy"), F.col("stamp").alias("best_stamp"))
    back = results.load_latest(spark, root, "portfolio", "buy_hold").join(newest, "strategy").join(best, "strategy")
    return out(back, ("strategy", *DAY, "stamp", "best_stamp"), "ret")
