"""Feature selection: variance, then the AUC of each feature on its own, by rank or by cross-fitted bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.ranks import binned_auc, rank_auc

CORE = ("open", "high", "low", "close", "volume")
MIN_VARIANCE, TOP_FEATURES, MIN_AUC = 0.01, 100, 0.52


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    return long.groupBy("feature").agg(F.var_pop("value").alias("variance"), F.var_samp("value").alias("variance_samp"))


def variance_filter(df: DataFrame, columns: Sequence[str], threshold: float = MIN_VARIANCE) -> DataFrame:
    return variances(df, columns).where(F.col("variance") > threshold)


def topk_by_variance(df: DataFrame, columns: Sequence[str], k: int = TOP_FEATURES) -> DataFrame:
    """The k features of the highest sample variance; k is the feature, the table has one row per column."""
    return variances(df, columns).orderBy(F.desc("variance_samp"), "feature").limit(k)


def feature_auc(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """max(auc, 1 - auc) per feature; 0.5 for a constant feature or a single class."""
    auc = rank_auc(df, columns, label)
    return auc.select("feature", F.coalesce(F.greatest("auc", 1 - F.col("auc")), F.lit(0.5)).alias("score"))


def feature_score_binned(
    df: DataFrame, columns: Sequence[str], label: str = "label", bins: int = 32, folds: int = 5, fold: Column | None = None
) -> DataFrame:
    """Cross-fitted AUC per feature, see ``ranks.binned_auc``; 0.5 for a constant feature or a single class. Finds features
    whose relation to the label turns, which no ranking does."""
    auc = binned_auc(df, columns, label, bins, folds, fold)
    return auc.select("feature", F.coalesce("auc", F.lit(0.5)).alias("score"))


SCORES = {"rank": feature_auc, "binned": feature_score_binned}


def feature_report(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "label",
    min_variance: float = MIN_VARIANCE,
    max_features: int | None = None,
    threshold: float = MIN_AUC,
    score: str = "rank",
) -> DataFrame:
    """Score and selection flags per feature. OHLCV columns are kept whatever their score. All features that vary are
    scored, by ``score`` (rank or binned); ``max_features`` keeps those of the highest variance only, if that is wanted."""
    var = variances(df, columns)
    rank = var.where(F.col("variance") > min_variance)
    if max_features is not None:
        rank = rank.orderBy(F.desc("variance_samp"), "feature").limit(max_features)
    scored = SCORES[score](df, columns, label).join(rank.select("feature", F.lit(1).alias("_in")), "feature")
    above = F.coalesce(F.col("score") > threshold, F.lit(False))
    return (
        var.select("feature")
        .join(scored.select("feature", "score"), "feature", "left")
        .select(
            "feature",
            "score",
            above.cast("int").alias("above_threshold"),
            (above | F.col("feature").isin(*CORE)).cast("int").alias("selected"),
        )
    )


def selected_features(report: DataFrame) -> list[str]:
    """Names only: one per column of the matrix."""
    return [r["feature"] for r in report.where("selected = 1").orderBy("feature").select("feature").collect()]


def top_features(report: DataFrame, n: int = 20) -> DataFrame:
    return report.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "feature").limit(n)
