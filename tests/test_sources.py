"""Snapshots by name and time, wide headers, rate files and the index of artefacts, on files written here."""

import os

import pytest
from pyspark.sql import functions as F

from barloom.sources import artefacts, bars, catalogue, rates

HEAD = "date,open,high,low,close,volume\n"


def put(path, text, age=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if age is not None:
        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def day(close):
    return f"2024-01-02,1,2,0.5,{close},10\n"


@pytest.fixture
def vendor_files(tmp_path):
    daily = tmp_path / "daily"
    put(daily / "AA" / "AA_daily_20240101_090000.csv", HEAD + day(1), 900)
    put(daily / "AA" / "AA_daily_20240301_090000.csv", HEAD + day(2), 1)
    put(daily / "AA" / "AA_daily_feed_20240201_235959.csv", HEAD + day(3), 2)
    put(daily / "AA" / "AA_daily_notes.csv", HEAD + day(4), 9_999)
    put(daily / "BB" / "BB_daily_feed_20251222105001.csv", HEAD + day(5), 50)
    put(daily / "BB" / "BB_daily_other.csv", "volume,close,low,high,open,caldt\n7,6,1,2,1,2024-01-02\n", 60)
    put(daily / "BB" / "raw_BB_daily_20990101_000000.csv", "not,a,snapshot\n", 10_000)
    put(tmp_path / "intraday" / "AA" / "AA_intraday_20990101_000000.csv", "caldt,open,high,low,close,volume\n2024-01-02 10:00:00,1,1,1,9,1\n", 5)
    return tmp_path


def test_newest_by_stamp_then_by_time(spark, vendor_files):
    got = catalogue.scan_latest(spark, str(vendor_files), "daily")
    assert sorted((r.symbol, r.close, r.volume) for r in got.collect()) == [("AA", 2.0, 10.0), ("BB", 6.0, 7.0)]
    opened = [p.rsplit("/", 1)[1] for p in got.inputFiles()]
    assert sorted(opened) == ["AA_daily_20240301_090000.csv", "BB_daily_other.csv"]
    minutes = catalogue.scan_latest(spark, str(vendor_files), "intraday").collect()
    assert [(r.symbol, r.ts.hour, r.close) for r in minutes] == [("AA", 10, 9.0)]
    files = catalogue.catalogue(spark, str(vendor_files))
    assert files.count() == 7 and files.where("stamp is null").count() == 3
    assert "ReadSchema" not in str(files) and "content" not in files.columns
    with pytest.raises(ValueError, match="no dividends"):
        catalogue.scan_latest(spark, str(vendor_files), "dividends")


def test_folders_are_snapshots_too(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", 1.0, 1.0, 1.0, c, 1.0) for c in (1.0, 2.0)], "day string, open double, high double, low double, close double, volume double")
    rows.repartition(2).write.parquet(f"{tmp_path}/CC_daily_20240101_000000.parquet")
    rows.where("close = 1").write.parquet(f"{tmp_path}/CC_daily_20230101_000000.parquet")
    assert sorted(r.close for r in catalogue.scan_latest(spark, str(tmp_path)).collect()) == [1.0, 2.0]


def test_three_header_lines(spark, tmp_path):
    put(tmp_path / "one.csv", "Ticker,TT,TT,UU\nPrice,Close,Adj Close,Open\nDate,,,\n2024-01-02 09:30:00,1.5,9,2\n2024-01-02 09:31:00,1.6,9,\n")
    put(tmp_path / "two.csv", "Ticker,VV\nPrice,Volume\nDate,\n2024-01-02 09:30:00,100\n")
    put(tmp_path / "three.csv", "Ticker,WW\nPrice,Close\nDate,\n")
    got = sorted((r.symbol, r.ts.minute, r.open, r.close, r.volume) for r in bars.scan_wide(spark, str(tmp_path)).collect())
    assert got == [("TT", 30, None, 1.5, None), ("TT", 31, None, 1.6, None), ("UU", 30, 2.0, None, None), ("VV", 30, None, None, 100.0)]
    put(tmp_path / "plain.csv", HEAD + day(1))
    with pytest.raises(ValueError, match="not a wide file"):
        bars.scan_wide(spark, str(tmp_path))


def test_rates_are_read_file_by_file(spark, tmp_path):
    put(tmp_path / "percent.csv", "date,rate\n2024-01-02,5.2\n2024-01-03,.\n2024-01-04,0.4\nnot a date,1\n")
    put(tmp_path / "decimal.csv", "date,rate\n2024-01-02,0.052\n2024-01-03,\n")
    got = rates.scan_rates(spark, [str(tmp_path / "percent.csv"), str(tmp_path / "decimal.csv")])
    rows = sorted((r.file.rsplit("/", 1)[1], str(r.day), r.rate and round(r.rate, 9)) for r in got.collect())
    assert rows == [
        ("decimal.csv", "2024-01-02", 0.052), ("decimal.csv", "2024-01-03", None),
        ("percent.csv", "2024-01-02", 0.052), ("percent.csv", "2024-01-03", None), ("percent.csv", "2024-01-04", 0.004),
    ]


def test_index_of_artefacts(spark, tmp_path):
    root = str(tmp_path)
    for key, stamp, path, metric in (("AA", "20240301_000000", "a2", 0.6), ("AA", "20240101_000000", "a1", 0.8), ("AA", "20240401_000000", "a3", None), ("BB", "20240101_000000", "b", 0.1)):
        artefacts.record(spark, root, "forest", key, stamp, path, metric)
    artefacts.record(spark, root, "other", "AA", "20250101_000000", "x", 0.9)
    assert artefacts.latest_path(spark, root, "forest", "AA") == "a3"
    assert sorted((r.key, r.path) for r in artefacts.best(spark, root, "forest").collect()) == [("AA", "a1"), ("BB", "b")]
    assert artefacts.latest(spark, root).count() == 3 and artefacts.latest(spark, root).where(F.col("stamp").isNull()).count() == 0
    with pytest.raises(FileNotFoundError):
        artefacts.latest_path(spark, root, "forest", "CC")
