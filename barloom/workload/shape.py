"""Output shape shared by the queries: key columns as they are, computed doubles rounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import rnd

BAR = ("symbol", "ts")
DAY = ("symbol", "day")


def out(df: DataFrame, keys, *columns: str, digits: int = 6) -> DataFrame:
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*keys, *[rnd(c, digits).alias(c) if c in doubles else F.col(c) for c in columns])


def r6(*columns: str) -> str:
    """The SQL counterpart of ``out``; adding 0 turns a rounded -0.0 into the 0.0 of Spark."""
    return ", ".join(f"round({c}, 6) + 0 AS {c}" for c in columns)
