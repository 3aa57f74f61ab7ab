"""An index of saved artefacts, appended with every save: which is the newest, which the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "kind string, key string, stamp timestamp_ntz, path string, metric double"


def record(spark: SparkSession, root: str, kind: str, key: str, stamp: str, path: str, metric: float | None = None) -> None:
    """Add one row for an artefact saved under ``path``; ``stamp`` is YYYYMMDD_HHMMSS, ``metric`` what ``best`` goes by."""
    when = F.to_timestamp(F.lit(stamp), "yyyyMMdd_HHmmss").cast("timestamp_ntz").alias("stamp")
    row = spark.range(1).select(
        F.lit(kind).alias("kind"), F.lit(key).alias("key"), when, F.lit(path).alias("path"), F.lit(metric).cast("double").alias("metric")
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/index")


def index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def latest(spark: SparkSession, root: str, kind: str | None = None, key: str | None = None) -> DataFrame:
    """The newest artefact of every kind and key, of all or of those asked for; equal stamps: the greatest path."""
    rows = index(spark, root)
    for name, value in (("kind", kind), ("key", key)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.groupBy("kind", "key").agg(F.max(F.struct("stamp", "path", "metric")).alias("_")).select("kind", "key", "_.*")


def best(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The artefact with the greatest metric for every key; equal ones: the newest. Artefacts without a metric never win."""
    rows = index(spark, root).where((F.col("kind") == kind) & F.col("metric").isNotNull() & ~F.isnan("metric"))
    return rows.groupBy("kind", "key").agg(F.max(F.struct("metric", "stamp", "path")).alias("_")).select("kind", "key", "_.*")


def latest_path(spark: SparkSession, root: str, kind: str, key: str) -> str:
    found = latest(spark, root, kind, key).first()
    if found is None:
        raise FileNotFoundError(f"no {kind} artefact for {key} below {root}")
    return found["path"]
