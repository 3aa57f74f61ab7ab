"""Mixing sources to target weights: thresholds on document hashes from nested histograms. SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of one histogram level: a source has at most 16 ** DIGITS buckets in it. A key has KEY digits in all.
DIGITS, KEY = 4, 32
#: Bytes of the table of sources up to which it is broadcast; beyond, rows are dealt by source and share.
BROADCAST, SHARES = 4 << 20, 64


def words_of(text: Column) -> Column:
    """Number of words; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _measured(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """source, size, key and the carried columns in one. The key orders documents by a hash of id and text; equal rows
    follow each other by a row number, so every key is unique and, up to equal rows, the same in every run."""
    text = F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text))
    row = F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), KEY // 2, "0"))
    rest = F.struct(*(F.col(f"`{c}`") for c in carry), F.lit(0).alias("_"))
    key = F.concat(F.substring(mark, 1, KEY // 2), row)
    return written(docs.select("source", words_of(F.col("text")).alias("size"), key.alias("key"), rest.alias("rest")), "measured")


def _ranked(sources: DataFrame) -> DataFrame:
    """Place of each source by code point, null last, from ranges and their counts."""
    order = (F.col("source").isNull(), F.col("source"))
    ranges = written(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("inside", inside).join(offsets, "range").select("source", "source_size", (F.col("inside") + F.col("before")).alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target for (source, source_size) rows, one per source.

    ``share`` times all sizes is dealt by weight, the weights repeating over the sources by code point, null last. A
    target stops at ``most`` times its source's size; what is left over goes to the others by weight until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(_ranked(sizes).withColumn("weight", weight), "sources")
    full = F.col("source_size") * most
    total, every = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, rest = share * (total or 0), every or 0
    while rest:
        above = F.col("weight") * F.lit(budget) / F.lit(rest) > full
        held, left = ranked.agg(F.sum(F.when(above, full)), F.sum(F.when(~above, F.col("weight")))).first()
        settled = (left or 0) == rest
        budget, rest = share * total - (held or 0), left or 0
        if settled:
            break
    fair = F.col("weight") * F.lit(float(budget)) / F.lit(rest) if rest else F.lit(float("inf"))
    return ranked.select("source", "source_size", F.least(fair, full.cast("double")).alias("target"))


def _beside(rows: DataFrame, small: DataFrame, broadcast: bool) -> DataFrame:
    """Rows with the columns of their source's row in ``small`` (its key renamed to ``_source``)."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    if broadcast:
        return rows.join(F.broadcast(small), same).drop("_source")
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("int"))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(copies, same & (F.col("_share") == F.col("_part"))).drop("_source", "_share", "_part")


def _thresholds(rows: DataFrame, targets: DataFrame, broadcast: bool) -> DataFrame:
    """_source, source_size, target, whole, edge, inside: documents are taken ``whole`` times and those whose key is
    below ``edge``, or begins with it where ``inside`` holds, once more.

    A level sums sizes by source and next digits of the key inside the bucket that the budget ends in, so each level
    reads the rows of one bucket a source only. It ends where that bucket holds one document, which goes to the
    nearer side.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("whole", times).select(
        F.col("source").alias("_source"), "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
    )
    state = written(state.withColumns({"edge": F.lit(""), "before": F.lit(0).cast("long"), "inside": F.lit(False)}), "edges")
    filled = rows.where("size > 0").select("source", "size", "key")
    done = state.where("budget <= 0")
    open_ = state.where("budget > 0")
    for level in range(KEY // DIGITS):
        if open_.isEmpty():
            break
        within = _beside(filled, open_.select("_source", "edge", "before", "budget"), broadcast)
        within = within.where(F.substring("key", 1, level * DIGITS) == F.col("edge"))
        digit = F.substring("key", level * DIGITS + 1, DIGITS).alias("digit")
        buckets = within.groupBy("source", "edge", "before", "budget", digit).agg(F.sum("size").alias("held"), F.count("*").alias("n"))
        upto = F.sum("held").over(W.partitionBy("source").orderBy("digit"))
        ends = buckets.withColumn("start", F.col("before") + upto - F.col("held")).where("start < budget and budget <= start + held")
        over, under = F.col("start") + F.col("held") - F.col("budget"), F.col("budget") - F.col("start")
        found = ends.select(
            F.col("source").alias("_s"), F.concat("edge", "digit").alias("edge"), F.col("start").alias("before"),
            ((F.col("n") == 1) & (over < under)).alias("inside"), "n",
        )
        known = open_.select("_source", "source_size", "target", "whole", "budget")
        moved = written(known.join(found, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"), "edges")
        done = done.unionByName(moved.where("n = 1").drop("n"))
        open_ = moved.where("n > 1").drop("n")
    return done.select("_source", "source_size", "target", "whole", "edge", "inside")


def mixed(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, carry: Sequence[str] | None = None
) -> DataFrame:
    """The ``carry`` columns of every document (default: all), and size (words), source_size, target, copies, taken.

    ``copies`` says how often the mix takes the document, 0 to ``most`` times; ``taken`` = copies x size. Of a source
    whose target is w whole passes and a rest, all documents are taken w times and those with the smallest hashes of
    id and text once more, up to the document that brings the sum nearest to the target. A larger share of the same
    source takes all that a smaller one takes. Reruns agree.

    Null ids, sources and texts are values of their own: null sources are mixed as one, null and empty texts have no
    words and are taken as often as their hash says. Equal rows are told apart by a row number only, so how many of
    them are taken is the same in every run. No documents give no rows. Carried columns of the names above would
    clash: they are an error.
    """
    carry = list(docs.columns if carry is None else carry)
    made = ["size", "source_size", "target", "copies", "taken"]
    if set(carry) & set(made):
        raise ValueError(f"carried columns clash with {made}: {sorted(set(carry) & set(made))}")
    rows = _measured(docs, carry)
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    weight = targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 128)).first()[0] or 0
    broadcast = weight <= BROADCAST
    edges = _thresholds(rows, targets, broadcast)
    low = F.substring(F.col("key"), F.lit(1), F.length("edge"))
    extra = (low < F.col("edge")) | ((low == F.col("edge")) & F.col("inside"))
    out = _beside(rows, edges, broadcast).withColumn("copies", (F.col("whole") + extra.cast("int")).cast("int"))
    return out.select(
        *(F.col("rest").getField(c).alias(c) for c in carry), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeated(plan: DataFrame) -> DataFrame:
    """The mix itself: every document of ``mixed`` as often as it is taken, with the number of the copy from 0."""
    return plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
