"""Feature scalers fitted on training rows: clip to mean +- k deviations, then scale.

Clipping is monotone, so minimum, maximum and quantiles of clipped values are the clipped
statistics of the raw ones; only the standard scaler needs a second pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import clip
from barloom.operators.ranks import exact_quantiles, quantiles_of, value_counts

KINDS = ("minmax", "standard", "robust")
NOT_FEATURES = frozenset(["date", "day", "caldt", "timestamp", "index", "symbol", "ts", "event_id", "label", "split"])


def feature_columns(df: DataFrame) -> list[str]:
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in numeric and c.lower() not in NOT_FEATURES]


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population deviation, extremes, median and interquartile range per column.

    ``df`` is read once, for the counts of its values; all else comes from them. Runs a job.
    """
    counts = value_counts(df, columns)
    n = F.col("_count")
    centre = counts.groupBy("feature").agg(
        (F.sum(F.col("value") * n) / F.sum(n)).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    off = F.col("value") - F.col("mean")
    spread = counts.join(F.broadcast(centre.select("feature", "mean")), "feature").groupBy("feature")
    spread = spread.agg(F.sqrt(F.sum(n * off * off) / F.sum(n)).alias("std"))
    q = quantiles_of(counts, [0.25, 0.5, 0.75])
    iqr = q.select("feature", F.col("q1").alias("median"), (F.col("q2") - F.col("q0")).alias("iqr"))
    done = centre.join(spread, "feature").join(iqr, "feature")
    return done.select("feature", "mean", "std", "min", "max", "median", "iqr")


@dataclass(frozen=True)
class Scaler:
    """x -> (clip(x) - center) / scale per column. As many parameters as columns."""

    kind: str
    params: dict[str, tuple[float, float, float, float]]
    """center, scale, lower, upper"""

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (center, scale, lower, upper) in self.params.items():
            if c in df.columns:
                out[c] = (clip(F.col(c).cast("double"), lower, upper) - center) / F.lit(scale)
        return df.withColumns(out)

    def inverse(self, df: DataFrame) -> DataFrame:
        """Values that were clipped stay clipped."""
        return df.withColumns(
            {c: F.col(c) * F.lit(s) + m for c, (m, s, _, _) in self.params.items() if c in df.columns}
        )

    def frame(self, spark) -> DataFrame:
        rows = [(c, *p) for c, p in sorted(self.params.items())]
        return spark.createDataFrame(rows, "feature string, center double, scale double, lower double, upper double")


def fit_scaler(
    df: DataFrame, columns: Sequence[str], kind: str = "minmax", clip_outliers: bool = True, outlier_std: float = 5.0
) -> Scaler:
    """Fit on ``df``, which must be the training rows. A constant column gets scale 1."""
    if kind not in KINDS:
        raise ValueError(f"unknown scaler {kind!r}; known: {KINDS}")
    x = {c: F.col(c).cast("double") for c in columns}
    stats = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    row = df.agg(*[f(x[c]).alias(f"{s}|{c}") for c in columns for s, f in stats.items()]).first()
    inf = float("inf")
    limits = {}
    for c in columns:
        m, s = row[f"mean|{c}"], row[f"std|{c}"]
        if m is None:
            raise ValueError(f"column {c!r} has no values to fit")
        limits[c] = (m - outlier_std * s, m + outlier_std * s) if clip_outliers else (-inf, inf)
    cut = lambda c, v: min(max(v, limits[c][0]), limits[c][1])
    fitted = {}
    if kind == "minmax":
        for c in columns:
            lo, hi = cut(c, row[f"min|{c}"]), cut(c, row[f"max|{c}"])
            fitted[c] = (lo, hi - lo)
    elif kind == "standard":
        clipped = {c: clip(x[c], *limits[c]) for c in columns}
        again = df.agg(
            *[F.avg(v).alias(f"mean|{c}") for c, v in clipped.items()],
            *[F.stddev_pop(v).alias(f"std|{c}") for c, v in clipped.items()],
        ).first()
        fitted = {c: (again[f"mean|{c}"], again[f"std|{c}"]) for c in columns}
    else:
        for r in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).collect():
            c = r["feature"]
            fitted[c] = (cut(c, r["q1"]), cut(c, r["q2"]) - cut(c, r["q0"]))
    return Scaler(kind, {c: (m, s if s else 1.0, *limits[c]) for c, (m, s) in fitted.items()})
