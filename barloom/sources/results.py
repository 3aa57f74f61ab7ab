"""Sweep rows, signals and portfolios on disk, laid out by strategy and symbol."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import artefacts

KINDS = ("simulation", "signals", "portfolio")


def sink_results(
    df: DataFrame, root: str, kind: str, strategy: str, config: Mapping[str, Any] | None = None, mode="overwrite"
) -> None:
    """Write results of one strategy; its configuration travels along as JSON."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    out = df.withColumn("strategy", F.lit(strategy))
    if config:
        out = out.withColumn("config", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in config.items()])))
    (
        out.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("strategy", "symbol")
        .parquet(f"{root}/{kind}")
    )


def publish_results(
    df: DataFrame, root: str, kind: str, strategy: str, stamp: str, config: Mapping[str, Any] | None = None, metric: float | None = None
) -> str:
    """Write results as a version of their own and add it to the index of ``root``, see ``artefacts``. Returns the path."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    path = f"{root}/{kind}_{strategy}_{stamp}"
    sink_results(df, path, kind, strategy, config)
    artefacts.record(df.sparkSession, root, kind, strategy, stamp, path, metric)
    return path


def load_latest(spark: SparkSession, root: str, kind: str, strategy: str) -> DataFrame:
    return load_results(spark, artefacts.latest_path(spark, root, kind, strategy), kind, strategy)


def load_results(spark: SparkSession, root: str, kind: str, strategy: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{kind}")
    return df.where(F.col("strategy") == strategy) if strategy else df
