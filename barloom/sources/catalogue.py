"""Snapshots by file name: which files hold the newest data, found before any of them is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.bars import DAILY_BARS, DIVIDENDS, INTRADAY, conform, file_path, read_csv

#: Kinds of snapshots and their columns.
SCHEMAS = {"intraday": INTRADAY, "daily": DAILY_BARS, "dividends": DIVIDENDS}
_NAME = r"^(.*/([^/_]+)_(intraday|daily|dividends)_([^/]*?)(?:\.csv|\.parquet)?)(?:/.*)?$"
_STAMP = r"^(?:.*_)?(\d{8}_\d{6})$"


def stamped(name: Column) -> Column:
    """The time YYYYMMDD_HHMMSS at the end of a name, NULL where there is none."""
    found = F.regexp_extract(name, _STAMP, 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot, symbol, kind, stamp, modified, bytes, path): every file below ``root`` named SYMBOL_kind_...

    A snapshot is a file ``SYMBOL_kind_[...][YYYYMMDD_HHMMSS].csv`` or a folder of that name with part files. Files of
    other names, such as those that begin with ``raw_``, are left out. Only the listing is read, no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = lambda n: F.regexp_extract("path", _NAME, n)
    found = files.select(
        part(1).alias("snapshot"), part(2).alias("symbol"), part(3).alias("kind"), stamped(part(4)).alias("stamp"),
        F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "path",
    )
    return found.where((F.col("snapshot") != "") & ~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]"))


def newest(files: DataFrame, keys: Sequence[str] = ("symbol", "kind")) -> DataFrame:
    """Files of the newest snapshot of every key: the latest stamp, or, where no name has one, the latest modification."""
    age = F.struct("stamp", "modified", "snapshot")
    best = files.groupBy(*keys).agg(F.max(age).alias("_best")).select(*keys, F.col("_best.snapshot").alias("snapshot"))
    return files.join(best, [*keys, "snapshot"], "left_semi")


def scan_latest(spark: SparkSession, root: str, kind: str = "daily", schema: T.StructType | None = None) -> DataFrame:
    """The newest snapshot of every symbol as (symbol, columns of the kind). Older files are never opened.

    The paths of the chosen files pass the driver, as those of any scan do. Runs the listing as a job.
    """
    wanted = newest(catalogue(spark, root).where(F.col("kind") == kind)).select("path").orderBy("path")
    paths = [r.path for r in wanted.collect()]
    symbol = F.regexp_extract(file_path(), _NAME, 2)
    named = lambda df: df.withColumn("symbol", symbol)
    own = schema or SCHEMAS[kind]
    groups = {fmt: [p for p in paths if p.endswith(".parquet") == (fmt == "parquet")] for fmt in ("parquet", "csv")}
    parts = [conform(named(spark.read.parquet(*groups["parquet"])), own)] if groups["parquet"] else []
    parts += read_csv(spark, groups["csv"], own, named) if groups["csv"] else []
    if not parts:
        raise ValueError(f"no {kind} snapshots below {root}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
