"""Risk-free rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.sources.bars import file_path


def decimal_rates(rates: DataFrame, percent: bool | None = None) -> DataFrame:
    """Rates as decimals. Without ``percent`` they count as percentages when their mean exceeds 1.

    One row per calendar day, so the mean over all of them is a small window.
    """
    rate = F.col("rate").cast("double")
    if percent is None:
        is_percent = F.avg(rate).over(W.partitionBy()) > 1
    else:
        is_percent = F.lit(percent)
    return rates.select("day", F.when(is_percent, rate / 100).otherwise(rate).alias("rate"))


def scan_rates(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, day, rate) of CSV files with a header ``date,rate``, as decimals.

    Each file is in percent or in decimals as a whole: in percent if the mean of its rates exceeds 1. Means are one row
    a file. Dates that are none are left out, a rate that is none is NULL.
    """
    rows = spark.read.option("header", True).schema("date string, rate string").csv(paths)
    rows = rows.select(file_path().alias("file"), F.expr("try_cast(date AS date)").alias("day"), F.expr("try_cast(rate AS double)").alias("rate"))
    rows = rows.where("day is not null")
    means = rows.groupBy("file").agg((F.avg("rate") > 1).alias("_percent"))
    percent = F.coalesce("_percent", F.lit(False))
    return rows.join(means, "file").select("file", "day", F.when(percent, F.col("rate") / 100).otherwise(F.col("rate")).alias("rate"))
