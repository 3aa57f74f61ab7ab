"""Classifier quality from a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import ratio
from barloom.operators.ranks import rank_auc


def class_distribution(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Share of each class; counts first, so the window sees one row per class."""
    from pyspark.sql.window import Window as W

    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts and ratios; a ratio without cases is 0."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    d = lambda e: F.expr(e).cast("double")
    precision = F.coalesce(ratio(d("tp"), d("tp + fp")), F.lit(0.0))
    recall = F.coalesce(ratio(d("tp"), d("tp + fn")), F.lit(0.0))
    return counts.withColumns(
        {
            "accuracy": ratio(d("tp + tn"), d("tp + fp + tn + fn")),
            "precision": precision,
            "recall": recall,
            "f1": F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0)),
        }
    )


def classifier_metrics(
    df: DataFrame, label="label", prediction="prediction", probability="probability", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion matrix, ratios and ROC AUC: one row, or one per group, all groups in one go."""
    auc = rank_auc(df, [probability], label, by=by).select(*by, F.col("auc").alias("roc_auc"))
    counts = confusion(df, by, label, prediction)
    if by:
        return counts.join(auc, list(by), "left")
    return counts.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
