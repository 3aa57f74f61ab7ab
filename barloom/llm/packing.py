"""Best-fit packing of documents into token sequences by hierarchical residual packing."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written
from barloom.llm.tokens import default_vocabulary, encoder
from barloom.llm.words import slices

#: Underfull bins that one task packs at once; more bins mean more tasks, never larger ones.
ITEMS_PER_TASK = 50_000


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0, remember: bool = True) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, without packing.

    A document's ids are those of its whole text (null: empty) and ``end_id``. Only documents of more than
    ``capacity`` ids are cut; all their pieces are full but the first, which may be shorter. Rows with equal doc_id
    count as documents of their own. Other columns of ``docs`` are not looked at. Without ``remember`` workers forget
    the ids of words at the end of each task: slower, but later stages have their memory.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, ids in zip(part["doc_id"].to_pylist(), enc.ids(part["text"].to_pylist())):
                    raw, start, k = ids + end, 0, 0
                    total = len(raw) // 4
                    stop = (total - 1) % capacity + 1
                    while start < total:
                        rows.append((doc, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                        start, stop, k = stop, stop + capacity, k + 1
                yield pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, r)) for r in rows], _PIECE)
        if not remember:
            enc.forget()
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > size:
            insort(room, (free - size, b))
    return bins


def _pack(capacity: int, slack: int):
    """Pack the bins of one partition: a bin is its size and the items in it, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table["size"].to_numpy()
            bins = best_fit(sizes, capacity)
            take = pa.array([i for b in bins for i in b], pa.int64())
            n = np.array([len(b) for b in bins])
            cuts = np.concatenate([[0], np.cumsum(n)])
            items = table["items"].combine_chunks().take(take)
            inner = np.concatenate([[0], np.cumsum(np.asarray(items.value_lengths()))])
            full = np.add.reduceat(sizes[np.asarray(take)], cuts[:-1])
            merged = pa.ListArray.from_arrays(pa.array(inner[cuts].astype(np.int32)), items.flatten())
            return pa.RecordBatch.from_arrays(
                [pa.array(full), pa.array(full + slack >= capacity), merged], names=["size", "closed", "items"]
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(["size", "items"]))
                rows += batch.num_rows
            if rows >= 2 * ITEMS_PER_TASK:
                yield done()
                held, rows = [], 0
        if rows:
            yield done()

    return run


_BIN = "size long, closed boolean, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def pack(cuts: DataFrame, capacity: int = 2048, slack: int = 8) -> DataFrame:
    """Add sequence_id and offset to pieces no longer than ``capacity``, in as few sequences as best fit finds.

    Every partition packs its pieces by best fit and closes bins with at most ``slack`` free places. The underfull bins
    of the partitions are merged as single items and packed again by fewer tasks, in rounds, until one task holds
    them all or a round gains nothing more. A task never holds more than a fixed number of bins: while there are more, the
    next round deals them anew over as many tasks as they need. Pieces of equal size are interchangeable, so ties
    only decide which of them meet. No piece is left out; an empty table gives an empty result.
    """
    spark = cuts.sparkSession
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    bins = cuts.select(F.col("length").alias("size"), F.array(item).alias("items"))
    bins = written(bins.mapInArrow(_pack(capacity, slack), _BIN), "bins")
    closed = [bins.where("closed")]
    left = bins.where("not closed")
    n, tasks = left.count(), None
    while n > 1:
        # a quarter of the tasks each round; by size classes across tasks, so that every task sees all sizes
        need = -(-n // ITEMS_PER_TASK)
        tasks = need if tasks is None else max(need, 1, min(need, tasks // 4))
        dealt = left.select("size", "items").repartition(tasks, F.xxhash64(F.col("items")[0]["doc_id"], "size", F.lit(n)))
        bins = written(dealt.mapInArrow(_pack(capacity, slack), _BIN), "bins")
        state = bins.agg(F.count("*").alias("n"), F.count_if(~F.col("closed")).alias("open")).first()
        closed.append(bins.where("closed"))
        left = bins.where("not closed")
        gained = n - state["n"]
        n = state["open"]
        if tasks == 1 or not gained:
            break
    done = left
    for part in closed:
        done = done.unionByName(part)
    # the first piece of a sequence names it: its document and piece are in no other sequence
    at = F.transform(
        F.sequence(F.lit(1), F.size("items")),
        lambda i: F.aggregate(F.slice("items", 1, i - 1), F.lit(0).cast("long"), lambda s, x: s + x["length"]),
    )
    done = done.select("items", at.alias("at"), F.monotonically_increasing_id().alias("sequence_id"))
    each = done.select("sequence_id", F.explode(F.arrays_zip("items", "at")).alias("x"))
    return each.select("x.items.*", "sequence_id", F.col("x.at").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, slack: int = 8, remember: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document.

    See ``pieces`` for how documents are cut and ``pack`` for the sequences. Null and empty texts are one end id.
    """
    cuts = written(pieces(docs, vocabulary, capacity, remember=remember), "pieces")
    return pack(cuts, capacity, slack)
