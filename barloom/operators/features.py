"""Model features over bars: the full matrix, cleaning, labels and the temporal split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.bars import price_position, time_features
from barloom.functions.numeric import finite, ratio
from barloom.functions.risk import drawdown
from barloom.operators import indicators as ind
from barloom.operators import recurrence as rec
from barloom.operators.selection import select_features
from barloom.session import materialize
from barloom.operators.series import BARS, Frame, Layout, Scan, blocked_scan, numbered, over_chunks

RAW = ("open", "high", "low", "close", "volume")
WARMUP_ROWS = 60


def raw_features(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    """The feature groups, not yet cleaned and without the drawdown, over one chunking of the series.

    RSI columns are those of rows whose price moves, and still hold ``indicators.ALL_GAIN``; ``fell__`` marks falls.
    Features run across day boundaries. ``minute_of_day`` and ``min_from_open`` replace bar
    columns of the same name.
    """
    missing = [c for c in RAW if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    smooth, step = ind.smoothing_stages()
    returns, risk = ind.risk_stages()
    plain = [
        ind.lag_stage,
        ind.std_stage(ind.WINDOWS),
        ind.sma_stage(ind.WINDOWS),
        ind.log_return_stage,
        ind.zscore_stage((20, 30)),
        ind.momentum_stage(),
        ind.volume_stage("vwap" in df.columns),
        returns,
    ]

    def together(f: Frame) -> dict[str, Column]:
        return {name: c for stage in plain for name, c in stage(f).items()}

    stages = [together, risk, *smooth]
    before = rec.halo(step, 2) + max(ind.WINDOWS)
    wide = over_chunks(df, stages, layout, before=before, step=step, keep_index=True, count=("close", "volume"))
    return wide.withColumns({**price_position(), **time_features()})


def feature_names(df: DataFrame, bars: DataFrame) -> list[str]:
    """Generated columns: everything the bars did not have, plus the replaced clock columns."""
    return [c for c in df.columns if c not in bars.columns]


def impute_fill(
    df: DataFrame, columns: Sequence[str], layout: Layout = BARS, also: Sequence[Scan] = (), unsettled: Sequence[str] = ()
) -> DataFrame:
    """Infinities to NULL, then fill forward, then backward, then with 0.

    The backward fill hands later values to the warm-up rows; ``drop_warmup`` removes those.
    ``also`` rides along in the same pass. ``unsettled`` are RSI columns of ``raw_features``, held as they are filled.
    """
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    fwd = [Scan(f"_f_{c}", "last", F.col(c)) for c in columns]
    # What a forward fill leaves open lies before the first known value, so that one fills it.
    # The first known RSI is never a placeholder: where there was a fall, it is not decayed yet.
    known = lambda c: F.when(F.col(c) != ind.ALL_GAIN, F.col(c)) if c in unsettled else F.col(c)
    bwd = [Scan(f"_b_{c}", "head", known(c)) for c in columns]
    filled = blocked_scan(clean, [*fwd, *bwd, *also], layout)
    held = lambda c: ind.settled(F.col(f"_f_{c}")) if c in unsettled else F.col(f"_f_{c}")
    return filled.withColumns(
        {c: F.coalesce(held(c), f"_b_{c}", F.lit(0.0)) for c in columns}
    ).drop(*[f"_f_{c}" for c in columns], *[f"_b_{c}" for c in columns])


def feature_matrix(
    df: DataFrame,
    drop_first: int | None = WARMUP_ROWS,
    layout: Layout = BARS,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Cleaned features of every bar, optionally without the warm-up rows.

    Two passes over the bars: one chunked, one blocked for the fills and the running maximum. The
    second reads its input twice, so the raw features, or those in ``only``, are written in between: building the
    frame runs a job.
    """
    raw = raw_features(df, layout)
    skip = {*layout.keys, *layout.order, "day", "event_id"}
    if only is not None:
        kept = [c for c in raw.columns if c in skip or c in only or c in ("close", "fell__", "_i", "_n")]
        raw = raw.select(*kept)
    raw = materialize(raw)
    floats = [c for c, t in raw.dtypes if t == "double" and c not in skip]
    peak = Scan("_peak", "max", F.col("close"))
    rsi = [c for c in (f"rsi_{p}" for p in ind.RSI_PERIODS) if c in floats]
    full = impute_fill(raw, floats, layout, [peak, ind.ever_fell()], rsi).withColumn("drawdown", drawdown(F.col("close"), F.col("_peak")))
    if drop_first:
        full = full.where((F.col("_i") >= drop_first) | (F.col("_n") <= drop_first))
    return full.drop("_peak", "fell__", "ever__", "_i", "_n")


def features_for_scoring(df: DataFrame, required: Sequence[str], layout: Layout = BARS) -> DataFrame:
    """Exactly the features a model asks for, on every bar; an unknown feature is an error."""
    return select_features(feature_matrix(df, None, layout, required), required)


def forward_label(
    df: DataFrame, horizon: int = 1, threshold: float = 0.001, drop_tail: bool = False, layout: Layout = BARS
) -> DataFrame:
    """1 where the close ``horizon`` bars ahead is higher by more than ``threshold``, else 0.

    The last bars have no future; they are labelled 0 unless ``drop_tail``.
    """

    def stage(f: Frame) -> dict[str, Column]:
        future = ratio(F.lead("close", horizon).over(f.rows), "close") - 1
        return {"label": F.coalesce(future > threshold, F.lit(False)).cast("int")}

    out = over_chunks(df, [stage], layout, after=horizon, keep_index=drop_tail)
    return out.where(F.col("_i") < F.col("_n") - horizon).drop("_i", "_n") if drop_tail else out


def temporal_split(
    df: DataFrame, train: float = 0.6, test: float = 0.2, valid: float = 0.2, layout: Layout = BARS
) -> DataFrame:
    """Column ``split``: the oldest rows train, the next test, the newest validate."""
    if abs(train + test + valid - 1.0) > 0.01:
        raise ValueError("split ratios must sum to 1")
    first = (F.col("_n") * F.lit(train)).cast("bigint")
    second = (F.col("_n") * F.lit(train + test)).cast("bigint")
    name = F.when(F.col("_i") < first, "train").when(F.col("_i") < second, "test").otherwise("valid")
    return numbered(df, layout).withColumn("split", name).drop("_i", "_n")
