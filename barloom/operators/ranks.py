"""Exact quantiles and rank AUC of many columns at once, without sorting a column in one task.

Columns are unpivoted and equal values merged map-side; the merged counts are written once and all
else reads them. Columns with more different values than a task should sort are cut into blocks by
approximate quantiles, which only steer the layout; running counts over the blocks give every value
its exact rank. Groups (``by``), such as the splits of a matrix, are worked on together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import bisect
from barloom.operators.series import BOUNDS_BROADCAST, Layout, Scan, blocked_scan
from barloom.session import materialize

ROWS_PER_BLOCK = 200_000
"""Different values of a column that one task sorts."""


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(keep), list(columns), "feature", "value").where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, _count): how often each value of each column occurs, written. Runs a job."""
    counts = unpivoted(df, columns, by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("_count"))
    return materialize(counts)


def _ranked(counts: DataFrame, running: Scan, by: Sequence[str], blocks: int | None) -> DataFrame:
    """``counts`` with a running sum by value, over as many blocks as the longest column needs."""
    keys = [*by, "feature"]
    if blocks is None:
        most = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        blocks = -(-most // ROWS_PER_BLOCK)
    if blocks <= 1:
        return blocked_scan(counts, [running], Layout(keys=tuple(keys), order=("value",), block=None))
    at = F.lit([i / blocks for i in range(1, blocks)])
    cuts = F.array_distinct(F.percentile_approx("value", at, F.lit(max(10_000, 10 * blocks))))
    bounds = materialize(counts.groupBy(*keys).agg(cuts.alias("_bounds")))
    total = bounds.agg(F.sum(F.size("_bounds"))).first()[0] or 0
    cut = counts.join(F.broadcast(bounds) if total <= BOUNDS_BROADCAST else bounds, keys)
    cut = cut.withColumn("_block", bisect("_bounds", "value", blocks, strict=True)).drop("_bounds")
    return blocked_scan(cut, [running], Layout(keys=tuple(keys), order=("value",), block="_block"))


def quantiles_of(counts: DataFrame, probabilities: Sequence[float], by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``exact_quantiles`` of counted values."""
    keys = [*by, "feature"]
    ranked = _ranked(counts, Scan("_upto", "sum", F.col("_count")), by, blocks)
    sizes = counts.groupBy(*keys).agg(F.sum("_count").alias("n"))
    ranked = ranked.join(sizes, keys)

    def order_statistic(k: Column) -> Column:
        """The k-th smallest value, k from 0: the first whose running count exceeds k."""
        return F.min(F.when(F.col("_upto") > k, F.col("value")))

    picks = []
    for j, p in enumerate(probabilities):
        h = F.lit(float(p)) * (F.col("n") - 1)
        picks += [
            order_statistic(F.floor(h)).alias(f"_lo{j}"),
            order_statistic(F.ceil(h)).alias(f"_hi{j}"),
            F.first(h - F.floor(h)).alias(f"_w{j}"),
        ]
    done = ranked.groupBy(*keys).agg(F.first("n").alias("n"), *picks)
    values = [
        (F.col(f"_lo{j}") + (F.col(f"_hi{j}") - F.col(f"_lo{j}")) * F.col(f"_w{j}")).alias(f"q{j}")
        for j in range(len(probabilities))
    ]
    return done.select(*keys, "n", *values)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], blocks: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per group and column with ``n`` and ``q0, q1, ...``, interpolated linearly between ranks."""
    return quantiles_of(value_counts(df, columns, by), probabilities, by, blocks)


def _auc(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, auc) from values with ``_pos`` and ``_neg`` rows and the running number ``_negs`` of negatives."""
    wins = F.col("_pos") * (F.col("_negs") - F.col("_neg") + F.col("_neg") / 2)
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.groupBy(*keys).agg((F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def _sides(label: str) -> list[Column]:
    return [F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")]


def rank_auc(
    df: DataFrame, columns: Sequence[str], label: str = "label", blocks: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Probability that a positive row ranks above a negative one, ties counted half, per group and column."""
    counts = materialize(unpivoted(df, columns, [*by, label]).groupBy(*by, "feature", "value").agg(*_sides(label)))
    return _auc(_ranked(counts, Scan("_negs", "sum", F.col("_neg")), by, blocks), [*by, "feature"])


def binned_auc(
    df: DataFrame, columns: Sequence[str], label: str = "label", bins: int = 32, folds: int = 5, fold: Column | None = None
) -> DataFrame:
    """(feature, auc): how well each column alone tells the label, whatever the shape of the relation.

    A column is cut into ``bins`` quantile bins. The score of a row is the share of positives in its bin, (p + 1) / (n + 2),
    among the rows of the other folds; AUC is that of the scores within each fold, averaged over the folds that have both
    labels. ``fold`` numbers the folds from 0; without it rows are dealt by a hash of the columns, so equal rows stay
    together. All columns are one job over (column, bin, fold) counts, and one before it for the bin edges.
    """
    dealt = F.pmod(F.xxhash64(*columns), F.lit(folds)) if fold is None else fold
    rows = df.select(label, dealt.cast("int").alias("_fold"), *columns)
    edges = quantiles_of(value_counts(rows, columns), [i / bins for i in range(1, bins)])
    edges = edges.select("feature", F.array(*(f"q{j}" for j in range(bins - 1))).alias("_edges"))
    # one array of bins - 1 numbers per column of the matrix
    long = unpivoted(rows, columns, [label, "_fold"]).join(F.broadcast(edges), "feature")
    bin_ = bisect("_edges", "value", bins, strict=True).alias("_bin")
    cells = materialize(long.groupBy("feature", bin_, "_fold").agg(*_sides(label)))
    whole = cells.groupBy("feature", "_bin").agg(F.sum("_pos").alias("_p"), F.sum(F.col("_pos") + F.col("_neg")).alias("_n"))
    others = F.col("_n") - F.col("_pos") - F.col("_neg")
    score = (F.col("_p") - F.col("_pos") + 1) / (others + 2)
    scored = cells.join(whole, ["feature", "_bin"]).groupBy("feature", "_fold", score.alias("value")).agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
    )
    keys = ["feature", "_fold"]
    # a column has no more scores in a fold than bins
    ranked = blocked_scan(scored, [Scan("_negs", "sum", F.col("_neg"))], Layout(keys=tuple(keys), order=("value",), block=None))
    return _auc(ranked, keys).groupBy("feature").agg(F.avg("auc").alias("auc"))
