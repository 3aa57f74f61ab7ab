"""Vectors as short codes: exact integer product quantisation, fitted over a lexicographic trie of distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

#: Parts of the trie whose distances are held at once, and the bound of an integer component: squares stay exact.
BLOCK, LARGEST = 2_048, 1 << 26
#: Shares into which a label is dealt where its total is joined back, so that a hot label is not one task.
SHARES = 32


def _numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q: components as integers. Rows with null vectors, null or non-finite components are gone."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = vectors.select("vec_id", "label", x.cast("array<double>").alias("embedding")).where(x.isNotNull() & finite)
    large = F.exists(x, lambda v: F.abs(v) * scale >= LARGEST - 1)
    message = F.lit(f"components must stay below {LARGEST} after scaling by {scale}")
    whole = F.when(large, F.raise_error(message)).otherwise(F.transform(x, lambda v: F.floor(v * scale).cast("int")))
    return usable.select("vec_id", "label", whole.alias("q"))


def _piece(q: Column, position: int, width: int) -> Column:
    return F.slice(q, position * width + 1, width)


def _exact(parts: np.ndarray, book: np.ndarray) -> type:
    """Doubles where every distance is an integer they hold exactly, else 64-bit integers."""
    high = max((int(np.abs(x).max()) for x in (parts, book) if x.size), default=0)
    return np.float64 if max(parts.shape[1], 1) * (2 * high) ** 2 < 1 << 53 else np.int64


def _square(x: np.ndarray) -> np.ndarray:
    return x * x


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of ``book`` (ties: lowest index) and its squared distance, for distinct parts in order.

    Rows in lexicographic order are the leaves of a trie whose edges are components. It is walked depth first; each
    node holds the distances of all entries over the components above it, and its children only add their own
    component. Where a branch has no more forks its tail is one matrix product.
    """
    n, width = parts.shape
    kind = _exact(parts, book)
    parts, book = parts.astype(kind), book.astype(kind)
    index, best = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def leaves(rows: np.ndarray, distances: np.ndarray) -> None:
        at = distances.argmin(axis=1)
        index[rows], best[rows] = at, distances[np.arange(len(rows)), at]

    def subtrees(lo: int, hi: int, depth: int, above: np.ndarray) -> None:
        """All leaves of a bounded range, a component at a time."""
        rows, node, held = np.arange(lo, hi), np.zeros(hi - lo, np.int64), above[None, :]
        for d in range(depth, width):
            value = parts[rows, d]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (node[1:] != node[:-1]) | (value[1:] != value[:-1])
            first = np.flatnonzero(fresh)
            held = held[node[first]] + _square(value[first, None] - book[:, d])
            alone = np.diff(np.append(first, len(rows))) == 1
            node = np.cumsum(fresh) - 1
            if alone.any():
                own = rows[first[alone]]
                tail, ends = parts[own, d + 1 :], book[:, d + 1 :]
                rest = _square(tail).sum(axis=1)[:, None] - 2 * (tail @ ends.T) + _square(ends).sum(axis=1)
                leaves(own, held[alone] + rest)
                stay = ~alone[node]
                rows, node, held = rows[stay], (np.cumsum(~alone) - 1)[node[stay]], held[~alone]
                if not len(rows):
                    return
        leaves(rows, held[node])

    stack = [(0, n, 0, np.zeros(len(book), kind))]
    while stack:
        lo, hi, depth, above = stack.pop()
        if hi - lo <= BLOCK or depth == width:
            if hi > lo:
                subtrees(lo, hi, depth, above)
            continue
        column = parts[lo:hi, depth]
        cuts = lo + np.append(np.flatnonzero(np.append(True, column[1:] != column[:-1])), hi - lo)
        # children that fit are walked together; a larger one goes deeper with its own distances
        begin = 0
        while begin < len(cuts) - 1:
            end = int(np.searchsorted(cuts, cuts[begin] + BLOCK, side="right")) - 1
            if end > begin:
                stack.append((int(cuts[begin]), int(cuts[end]), depth, above))
            else:
                end = begin + 1
                child = above + _square(parts[cuts[begin], depth] - book[:, depth])
                stack.append((int(cuts[begin]), int(cuts[end]), depth + 1, child))
            begin = end
    return index, best


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and which of them each row is."""
    if not rows.shape[1]:
        return rows[:1], np.zeros(len(rows), np.int64)
    order = np.lexsort(rows.T[::-1])
    held = rows[order]
    fresh = np.append(True, (held[1:] != held[:-1]).any(axis=1))
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return held[fresh], back


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weighted sums of the parts that each entry takes: one row per entry and component that a task has met."""
    count, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, taken = np.zeros((count, entries, width), np.int64), np.zeros((count, entries), np.int64)
        for batch in batches:
            position, weight, parts = batch["position"].to_numpy(), batch["weight"].to_numpy(), _rows(batch["part"], width)
            for p in np.unique(position):
                mine = position == p
                distinct, back = _ordered(parts[mine])
                heavy = np.zeros(len(distinct), np.int64)
                np.add.at(heavy, back, weight[mine])
                index, _ = nearest(distinct, books[p])
                np.add.at(total[p], index, distinct * heavy[:, None])
                np.add.at(taken[p], index, heavy)
        p, e = np.nonzero(taken)
        if len(p):
            rows = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), total[p, e].ravel(), np.repeat(taken[p, e], width)]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["position", "entry", "place", "total", "n"])

    return run


def _encoded(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    count, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _rows(batch["q"], count * width)
            index, error = np.zeros((len(vectors), count), np.uint8), np.zeros(len(vectors), np.int64)
            for p in range(count if len(vectors) else 0):
                distinct, back = _ordered(vectors[:, p * width : (p + 1) * width])
                at, distance = nearest(distinct, books[p])
                index[:, p] = at[back]
                error += distance[back]
            codes = pa.array([row.tobytes().hex() for row in index], pa.string())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], codes, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _fit(numbers: DataFrame, width: int, count: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component). Only they pass the driver: entries x components numbers, whatever the rows."""
    first = numbers.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    books = np.array([r.q for r in first], np.int64).reshape(len(first), count, width).transpose(1, 0, 2).copy()
    if not len(first):
        return books
    pieces = F.array(*(F.struct(F.lit(p).alias("position"), _piece(F.col("q"), p, width).alias("part")) for p in range(count)))
    distinct = numbers.select(F.explode(pieces).alias("piece")).groupBy("piece.position", "piece.part").agg(F.count("*").alias("weight"))
    # equal parts meet once with their number; in order, neighbours share their first components
    trie = written(distinct.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")
    for _ in range(rounds):
        sums = trie.mapInArrow(_sums(books), "position long, entry long, place long, total long, n long")
        rows = sums.groupBy("position", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in rows:
            books[r.position, r.entry, r.place] = r.total // r.n
    return books


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) for each usable vector, and the codebooks (part, entry, component).

    A component x becomes floor(scale * x). Codebooks start as the parts of the ``entries`` smallest vec_ids (null ids
    last, equal ids by vector); every round moves an entry to the floored mean of the parts nearest to it (ties: lower
    index), an unused one stays. ``code`` has two hex digits a part, ``error`` the squared distance, ``label_error``
    its sum over a label, null labels together. Integers throughout, so any order of work gives the same numbers.

    Rows whose vector is null or has null or non-finite components are left out; repeated rows and ids each count and
    each give a row; no rows give no rows and empty codebooks. Vectors are padded with zeros to the smallest multiple of
    ``parts`` that holds the longest one. Components of 2^26 or more after scaling are an error. Other columns are not
    looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256: codes have two hex digits a part")
    numbers = _numbers(vectors, scale)
    longest = numbers.agg(F.max(F.size("q"))).first()[0] or 0
    width = -(-longest // parts)
    padded = F.concat("q", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("q")))
    numbers = written(numbers.select("vec_id", "label", padded.alias("q")), "numbers")
    books = _fit(numbers, width, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in numbers.schema}
    coded = numbers.mapInArrow(_encoded(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = written(coded, "codes").withColumn("_share", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SHARES)).cast("int"))
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    totals = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_share") == F.col("_part"))
    return coded.join(totals, same).select("vec_id", "label", "code", "error", "label_error"), books
