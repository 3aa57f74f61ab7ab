"""Ordered work over keyed time series without ever putting a whole series into one task.

Two facts shape this module. A single symbol may hold a third of all rows, so
``Window.partitionBy("symbol")`` over bars is not an option. And ordered operators come in two
kinds, each of which splits cleanly:

* *running* operators (running sum, running maximum, forward and backward fill) combine
  associatively. ``blocked_scan`` runs them inside a time block, reduces each block to one row,
  scans those few rows and joins the result back.
* *bounded* operators (lag, rolling statistics, exponential smoothing) look at a fixed number of
  neighbouring rows. ``over_chunks`` numbers the rows of a series, cuts it into chunks of equal
  length and copies the needed neighbours ("halo") into the next chunk.

A ``Layout`` says how a frame is keyed, ordered and blocked. ``block=None`` is for series whose
length has a fixed bound: the bars of one day, or one row per calendar day. Ticks have no such bound;
``cut_blocks`` splits the days that are too long for one task into ranges of time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.numeric import bisect
from barloom.session import materialize

ROWS_PER_CHUNK = 32768
ROWS_PER_BLOCK = 1_000_000
BOUNDS_BROADCAST = 200_000
"""Bounds of blocks, 8 bytes each, up to which they are broadcast; beyond, rows are joined with them."""


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    block: str | None = "day"
    rows: int = ROWS_PER_CHUNK

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, *([self.block] if self.block else [])]

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.block_keys).orderBy(*self.order)

    def order_value(self) -> Column:
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)


BARS = Layout()
"""A whole series of bars or ticks of a symbol, cut by its ``day`` column."""

DAY = Layout(keys=("symbol", "day"), block=None)
"""The bars of one symbol on one day: at most 1440 rows at one-minute resolution."""

DAILY = Layout(order=("day",), block=None)
"""One row per symbol and calendar day."""


def cut_blocks(df: DataFrame, layout: Layout = BARS, target: int = ROWS_PER_BLOCK, block: str = "_block") -> tuple[DataFrame, Layout]:
    """``df`` with the column ``block``, and the layout that uses it: ranges of time of about ``target`` rows, in order.

    Works for series of timestamps with a ``day`` column, of any number of rows a day. Rows are counted by second, a
    table of at most 86,400 rows a series and day; running counts over it say where a day is cut. Only days of more than
    ``target`` rows are; if there are none, frame and layout come back as they are. Results never depend on the bounds,
    and a second is never split. Runs a job: it reads keys, day and timestamps of ``df`` once.
    """
    (ts,) = layout.order
    group = list(dict.fromkeys([*layout.block_keys, "day"]))
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    bins = df.groupBy(*group, second.alias("_bin")).agg(F.count(F.lit(1)).alias("_rows"), F.min(ts).alias("_from"))
    upto = W.partitionBy(*group).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    nth = F.floor((F.sum("_rows").over(upto) - F.col("_rows")) / target)
    starts = bins.withColumn("_nth", nth).where("_nth > 0").groupBy(*group, "_nth").agg(F.min("_from").alias("_from"))
    bounds = materialize(starts.groupBy(*group).agg(F.sort_array(F.collect_list("_from")).alias("_bounds")))
    most, total = bounds.agg(F.max(F.size("_bounds")), F.sum(F.size("_bounds"))).first()
    if not most:
        return df, layout
    cut = df.join(F.broadcast(bounds) if total <= BOUNDS_BROADCAST else bounds, group, "left")
    part = bisect("_bounds", ts, most)
    number = F.struct(F.col(layout.block), part) if layout.block else part
    return cut.withColumn(block, number).drop("_bounds"), replace(layout, block=block)


@dataclass(frozen=True)
class Scan:
    """One running operator: ``kind`` is sum, max, min, last (forward fill), next (back fill) or
    head (the first known value of the whole series, on every row)."""

    out: str
    kind: str
    value: Column
    exclusive: bool = False
    """Leave out the current row. ``last`` of a struct is then the lag across blocks."""


def _running(scan: Scan, part: Sequence[str], order: Sequence[str], exclusive: bool) -> Column:
    """A growing frame in either direction. Back fill runs forward over the reversed order, because
    a frame that ends at the last row would be walked again for every row."""
    if scan.kind == "head":
        whole = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return F.first(scan.value, ignorenulls=True).over(whole)
    back = scan.kind == "next"
    by = [F.desc(o) for o in order] if back else list(order)
    frame = W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    if scan.kind in ("last", "next"):
        return F.last(scan.value, ignorenulls=True).over(frame)
    return getattr(F, scan.kind)(scan.value).over(frame)


def _total(scan: Scan, order: Column) -> Column:
    seen = F.when(scan.value.isNotNull(), order)
    if scan.kind == "last":
        return F.max_by(scan.value, seen)
    if scan.kind in ("next", "head"):
        return F.min_by(scan.value, seen)
    return getattr(F, scan.kind)(scan.value)


def _merge(kind: str, local: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.when(local.isNotNull() | carried.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)))
    if kind == "max":
        return F.greatest(local, carried)
    if kind == "min":
        return F.least(local, carried)
    return F.coalesce(local, carried)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition into the session's number of shuffle partitions.

    A plain shuffle would be merged into few tasks when its input is small, although the steps
    after it multiply rows or are heavy; a shuffle with a fixed number is left alone. Windows and
    aggregates on a superset of ``keys`` reuse it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def blocked_scan(df: DataFrame, scans: Sequence[Scan], layout: Layout = BARS) -> DataFrame:
    """Add running columns. One shuffle on (keys, block); the carried part is one row per block."""
    rows = [s for s in scans if s.kind != "head" or layout.block is None]
    local = df.withColumns({s.out: _running(s, layout.block_keys, layout.order, s.exclusive) for s in rows})
    if layout.block is None:
        return local
    order = layout.order_value()
    totals = df.groupBy(*layout.block_keys).agg(*[_total(s, order).alias(s.out) for s in scans])
    carried = totals.select(
        *layout.block_keys,
        *[
            _running(Scan(s.out, s.kind, F.col(s.out)), layout.keys, [layout.block], True).alias(f"_in_{s.out}")
            for s in scans
        ],
    )
    joined = local.join(carried, layout.block_keys, "left")
    return joined.withColumns(
        {
            s.out: _merge(s.kind, F.col(s.out), F.col(f"_in_{s.out}")) if s.kind != "head" else F.col(f"_in_{s.out}")
            for s in scans
        }
    ).drop(*[f"_in_{s.out}" for s in scans])


def numbered(df: DataFrame, layout: Layout = BARS, index: str = "_i", size: str = "_n") -> DataFrame:
    """Add the 0-based position of a row in its series and the length of the series."""
    local = df.withColumn(index, (F.row_number().over(layout.window()) - 1).cast("bigint"))
    if layout.block is None:
        return local.withColumn(size, F.count(F.lit(1)).over(W.partitionBy(*layout.keys)))
    across = W.partitionBy(*layout.keys)
    offsets = (
        df.groupBy(*layout.block_keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *layout.block_keys,
            F.coalesce(
                F.sum("_rows").over(across.orderBy(layout.block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
            F.sum("_rows").over(across).alias(size),
        )
    )
    return (
        local.join(offsets, layout.block_keys)
        .withColumn(index, F.col(index) + F.col("_offset"))
        .drop("_offset")
    )


@dataclass(frozen=True)
class Frame:
    """What a stage of ``over_chunks`` may build on: window specs and row position."""

    rows: WindowSpec
    sub: WindowSpec
    step: int
    part: tuple[str, ...] = ()
    """Columns that all windows are partitioned by."""
    counted: frozenset[str] = frozenset()
    """Columns whose running count is at hand as ``_n_<column>``."""

    @property
    def i(self) -> Column:
        return F.col("_i")

    @property
    def k(self) -> Column:
        """Position inside the sub-block, from 1 to ``step``."""
        return F.col("_i") % self.step + 1

    def last(self, n: int, skip: int = 0) -> WindowSpec:
        """The n rows that end ``skip`` rows before the current one."""
        return self.rows.rowsBetween(-(n - 1) - skip, -skip)

    def seen(self, column: str, n: int, skip: int = 0) -> Column:
        """Known values among the ``last(n, skip)`` rows; a difference of running counts if possible."""
        if column not in self.counted:
            return F.count(column).over(self.last(n, skip))
        upto = F.lag(f"_n_{column}", skip).over(self.rows) if skip else F.col(f"_n_{column}")
        older = F.lag(f"_n_{column}", n + skip).over(self.rows)
        return F.coalesce(upto, F.lit(0)) - F.coalesce(older, F.lit(0))

    def before(self) -> WindowSpec:
        return self.rows.rowsBetween(W.unboundedPreceding, -1)


Stage = Callable[[Frame], dict[str, Column]]


def over_chunks(
    df: DataFrame,
    stages: Sequence[Stage],
    layout: Layout = BARS,
    before: int = 0,
    after: int = 0,
    step: int | None = None,
    keep_index: bool = False,
    count: Sequence[str] = (),
) -> DataFrame:
    """Add columns computed from at most ``before`` earlier and ``after`` later rows of a series.

    Stages run one after another and may use the columns of earlier stages; columns that start
    with an underscore are dropped at the end. All windows of a call share one partitioning and
    one sort order, (keys, chunk, sub-block, position), so the call costs one sort. For columns in
    ``count``, stages get the number of known values in a frame without walking the frame.
    """
    step = step or layout.rows
    inner = numbered(spread(df, *layout.keys) if layout.block is None else df, layout)
    part = [*layout.keys]
    if layout.block is not None:
        size = max(layout.rows, 1)
        first = F.greatest(F.floor((F.col("_i") - after) / size), F.lit(0))
        final = F.least(F.floor((F.col("_i") + before) / size), F.floor((F.col("_n") - 1) / size))
        inner = inner.withColumn("_c", F.explode(F.sequence(first, final)))
        part.append("_c")
        inner = spread(inner, *part)
    inner = inner.withColumn("_s", F.floor(F.col("_i") / step))
    frame = Frame(
        rows=W.partitionBy(*part).orderBy("_s", "_i"),
        sub=W.partitionBy(*part, "_s").orderBy("_i").rowsBetween(W.unboundedPreceding, 0),
        step=step,
        part=tuple(part),
        counted=frozenset(count),
    )
    upto = frame.rows.rowsBetween(W.unboundedPreceding, 0)
    if count:
        inner = inner.withColumns({f"_n_{c}": F.count(c).over(upto) for c in count})
    for stage in stages:
        inner = inner.withColumns(stage(frame))
    if layout.block is not None:
        inner = inner.where(F.col("_c") == F.floor(F.col("_i") / layout.rows))
    own = {"_i", "_n"} if keep_index else set()
    keep = [c for c in inner.columns if not c.startswith("_") or c in own or c in df.columns]
    return inner.select(*keep)
