"""Reading, checking and writing bar snapshots.

Snapshots live under ``root/symbol=.../version=YYYYMMDD_HHMMSS/``; a whole universe is one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import finite

_PRICES = ["open", "high", "low", "close", "volume"]
INTRADAY = T.StructType([T.StructField("ts", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in _PRICES])
DAILY_BARS = T.StructType([T.StructField("day", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in _PRICES])
DIVIDENDS = T.StructType([T.StructField("day", T.DateType()), T.StructField("dividend", T.DoubleType())])
_ALIASES = {"caldt": None, "date": None, "datetime": None, "timestamp": None}


def conform(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ("symbol", "version")) -> DataFrame:
    """Lower-case the names, check the required columns and cast them. NaN becomes NULL.

    A vendor's time column is renamed to that of the schema; anything else, such as an index
    column in front, is dropped.
    """
    time = schema[0].name
    names = {}
    for c in df.columns:
        low = c.strip().lower()
        names[c] = time if low in _ALIASES else low
    low = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if n])
    missing = [f.name for f in schema if f.name not in low.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    cast = lambda f: finite(F.col(f.name).cast("double")) if f.dataType == T.DoubleType() else F.col(f.name).cast(f.dataType)
    return low.select(*[k for k in keep if k in low.columns], *[cast(f).alias(f.name) for f in schema])


def file_path() -> Column:
    """The file of a row, as readers take it; Spark hands it out percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def heads(text: DataFrame, lines: int = 1) -> DataFrame:
    """(head, paths): files of ``text`` by their first lines, an array. The first block of a file is read by one task, so
    its lines are numbered in order."""
    rows = text.select("value", file_path().alias("path"), F.col("_metadata.file_block_start").alias("at"))
    first = rows.where("at = 0").withColumn("_n", F.monotonically_increasing_id())
    if lines == 1:
        tops = first.groupBy("path").agg(F.array(F.min_by("value", "_n")).alias("head"))
    else:
        starts = first.groupBy("path").agg(F.min("_n").alias("_from"))
        top = first.join(starts, "path").where(F.col("_n") < F.col("_from") + lines)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda r: r.value)
        tops = top.groupBy("path").agg(ordered.alias("head"))
    return tops.groupBy("head").agg(F.collect_list("path").alias("paths"))


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, named: Callable[[DataFrame], DataFrame] = lambda df: df, root: str | None = None
) -> list[DataFrame]:
    """One frame for each different header among CSV files, conformed to ``schema``; a first job reads the headers.

    ``named`` adds columns read off the file names; ``root`` is where partition folders begin.
    """
    text = spark.read.text(paths, recursiveFileLookup=True)
    found = heads(text).orderBy("head").collect()
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.option("basePath", root) if root else reader
    return [conform(named(reader.csv(r.paths)), schema) for r in found]


def scan_bars(spark: SparkSession, root: str, schema: T.StructType = DAILY_BARS, fmt: str = "parquet") -> DataFrame:
    """All symbols and versions below ``root``. CSV columns are found by the header of their own file.

    Files may differ in their columns and their order: a first job finds the header of each file, and files with the
    same one are read together. It reads the text once more; large snapshots belong in Parquet, and where only the
    newest ones are wanted, ``catalogue.scan_latest`` opens no others.
    """
    if fmt != "csv":
        return conform(spark.read.format(fmt).load(root), schema)
    parts = read_csv(spark, root, schema, root=root)
    if not parts:
        return conform(spark.read.option("header", True).csv(root), schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def sink_bars(df: DataFrame, root: str, version: str, fmt: str = "parquet") -> None:
    """Write one snapshot of all symbols; an existing version of a symbol is replaced."""
    out = df.withColumn("version", F.lit(f"v{version}"))
    writer = out.repartition("symbol", *[c for c in ("day",) if c in df.columns]).write
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "version")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(root)


def file_version(path: Column) -> Column:
    """Time stamp YYYYMMDD_HHMMSS in a path, NULL where there is none."""
    found = F.regexp_extract(path, r"(\d{8}_\d{6})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def latest_version(df: DataFrame, keys: Sequence[str] = ("symbol",), version: str = "version") -> DataFrame:
    """Rows of the newest version of every key. Only the few (key, version) pairs are ranked. A NULL version is older
    than any other; where a key has no other, its rows stay."""
    newest = df.groupBy(*keys).agg(F.max(version).alias("_newest")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_newest")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return df.join(newest, same & F.col(version).eqNullSafe(F.col("_newest")), "left_semi")


def snapshot_inventory(df: DataFrame, time: str = "day") -> DataFrame:
    return df.groupBy("symbol", "version").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last")
    )


def schema_contract(df: DataFrame, schema: T.StructType, min_rows: int = 1) -> DataFrame:
    """Per symbol: rows, rows without a complete record, and whether there are enough of them."""
    good = conform(df, schema)
    broken = F.lit(False)
    for f in schema:
        broken = broken | F.col(f.name).isNull()
    n = F.count(F.lit(1))
    return good.groupBy("symbol").agg(
        n.alias("n_rows"), F.count_if(broken).alias("n_incomplete"), (n >= min_rows).cast("int").alias("long_enough")
    )


def wide_to_long(df: DataFrame, time: str = "day", separator: str = "|") -> DataFrame:
    """Columns named ``symbol|field`` to one row per symbol and time."""
    pairs = [c for c in df.columns if separator in c]
    long = df.unpivot([time], pairs, "_pair", "_value")
    parts = F.split("_pair", f"[{separator}]")
    fields = [*_PRICES]
    picked = [F.max(F.when(F.col("_field") == f, F.col("_value"))).alias(f) for f in fields]
    return (
        long.withColumns({"symbol": parts[0], "_field": F.lower(parts[1])})
        .groupBy("symbol", time)
        .agg(*picked)
        .where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
    )


#: First cells of the three header lines of a wide vendor file: symbols, fields, and the name of the time column.
WIDE_HEAD = ("Ticker", "Price", "Date")


def scan_wide(spark: SparkSession, paths: str | Sequence[str], time: T.StructField = INTRADAY[0]) -> DataFrame:
    """Wide vendor files to one row per symbol and time.

    A file has three header lines: a symbol and a field per column, then the name of the time column. A small job reads
    these lines of every file and makes one name of each column's symbol and field; files with the same columns are
    read together. Fields other than open, high, low, close and volume are left out.
    """
    found = heads(spark.read.text(paths, recursiveFileLookup=True), 3).orderBy("head").collect()
    parts = []
    for r in found:
        symbols, fields = ([c.strip() for c in line.split(",")] for line in r.head[:2])
        if (symbols[0], fields[0]) != WIDE_HEAD[:2]:
            raise ValueError(f"not a wide file, its lines begin {symbols[0]!r}, {fields[0]!r}: {r.paths[0]}")
        names = [time.name, *(f"{s}|{f}" for s, f in zip(symbols[1:], fields[1:]))]
        raw = spark.read.csv(r.paths, schema=", ".join(f"c{i} string" for i in range(len(names))))
        body = raw.where(F.coalesce(~F.col("c0").isin(*WIDE_HEAD), F.lit(False)))
        use = [(i, n) for i, n in enumerate(names) if i == 0 or n.rpartition("|")[2].lower() in _PRICES]
        kinds = [F.col(f"c{i}").cast(time.dataType if i == 0 else "double").alias(n) for i, n in use]
        parts.append(wide_to_long(body.select(*kinds), time.name))
    if not parts:
        raise ValueError(f"no wide files below {paths}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
