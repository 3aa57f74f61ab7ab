"""Token-id files: checksummed blocks of an adaptive range coder, and their reader.

A file is a run of blocks in ascending document order. A block holds up to ``BLOCK`` ids, is coded from an empty model
(see ``coder``) and carries a checksum, so any block is read without the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.coder import decode_blocks, encode_blocks
from barloom.llm.common import written
from barloom.llm.tokens import default_vocabulary, encoder
from barloom.llm.words import slices

#: Ids of a block; the last block of a partition may be shorter.
BLOCK = 2048
#: Blocks that are coded side by side.
LANES = 2048

_FILE = (
    "file int, block int, n_tokens int, crc32 long, payload binary, "
    "docs array<struct<doc_id:long,part:int,n_tokens:int>>"
)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, files: int | None = None) -> None:
    """Write the ids of every whole text and ``end_id``, in ascending doc_id order, as blocks in ``folder``.

    Files are ranges of doc_id; a row is a block with its ids' checksum and the (part of a) document each run of its
    ids belongs to. A null text counts as empty. Rows that share a doc_id follow each other in one file, in no fixed
    order. Other columns are not looked at; an empty table gives a folder without blocks.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file, block = encoder(path), TaskContext.get().partitionId(), 0
        ids, runs, size = [], [], 0  # of the open block
        full: list[tuple[np.ndarray, list]] = []

        def coded() -> pa.RecordBatch:
            nonlocal block
            payloads = encode_blocks([b for b, _ in full])
            rows = [
                {"file": file, "block": block + k, "n_tokens": len(b), "crc32": zlib.crc32(b.astype("<u4").tobytes()), "payload": p, "docs": r}
                for k, ((b, r), p) in enumerate(zip(full, payloads))
            ]
            block += len(full)
            full.clear()
            return pa.RecordBatch.from_pylist(rows, _BLOCKS)

        for batch in batches:
            for part in slices(batch):
                for doc, raw in zip(part["doc_id"].to_pylist(), enc.ids(part["text"].to_pylist())):
                    rest, k = np.frombuffer(raw + end, "<u4"), 0
                    while len(rest):
                        own, rest = rest[: BLOCK - size], rest[BLOCK - size :]
                        ids.append(own)
                        runs.append({"doc_id": doc, "part": k, "n_tokens": len(own)})
                        size += len(own)
                        k += 1
                        if size == BLOCK:
                            full.append((np.concatenate(ids), runs))
                            ids, runs, size = [], [], 0
                            if len(full) == LANES:
                                yield coded()
        if size:
            full.append((np.concatenate(ids), runs))
        if full:
            yield coded()

    rows = docs.select("doc_id", "text")
    dealt = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id").mapInArrow(code, _FILE).write.parquet(folder)


_BLOCKS = pa.schema(
    [
        ("file", pa.int32()),
        ("block", pa.int32()),
        ("n_tokens", pa.int32()),
        ("crc32", pa.int64()),
        ("payload", pa.binary()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32())]))),
    ]
)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, LANES):
            rows = batch.slice(at, LANES).to_pylist()
            for row, ids in zip(rows, decode_blocks([r["payload"] for r in rows], [r["n_tokens"] for r in rows])):
                if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of file {row['file']} is damaged")
                yield row, ids


def _run_rows(with_ids: bool):
    """The runs of decoded blocks: where they lie, their checksum and, if wanted, their ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row, ids in _decoded(batches):
            at = 0
            for k, run in enumerate(row["docs"]):
                raw = ids[at : at + run["n_tokens"]].astype("<u4")
                rows.append({"file": row["file"], "block": row["block"], "run": k, **run, "crc32": zlib.crc32(raw.tobytes())})
                if with_ids:
                    rows[-1]["ids"] = raw.astype(np.int32)
                at += run["n_tokens"]
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, _RUNS if with_ids else _RUNS.remove(7))
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _RUNS if with_ids else _RUNS.remove(7))

    return read


_RUNS = pa.schema(
    [("file", pa.int32()), ("block", pa.int32()), ("run", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
)
_RUN = "file int, block int, run int, doc_id long, part int, n_tokens int, crc32 long"


def read_token_files(docs_folder: DataFrame) -> DataFrame:
    """doc_id, part, ids of every run of ids in token files (``spark.read.parquet`` of their folder)."""
    return docs_folder.mapInArrow(_run_rows(True), _RUN + ", ids array<int>").select("doc_id", "part", "ids")


def _times_zeros(crc: int, n: int) -> int:
    """The checksum register after ``n`` zero bytes: n squarings of one linear step."""

    def apply(matrix: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= matrix[i]
        return out

    if n not in _zero_steps:
        step = []
        for i in range(32):
            v = 1 << i
            for _ in range(8):
                v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
            step.append(v)
        total, left = [1 << i for i in range(32)], n
        while left:
            if left & 1:
                total = [apply(step, v) for v in total]
            step = [apply(step, v) for v in step]
            left >>= 1
        if len(_zero_steps) > 10_000:
            _zero_steps.clear()
        _zero_steps[n] = total
    return apply(_zero_steps[n], crc)


_zero_steps: dict[int, list[int]] = {}


def join_crc32(parts: list[tuple[int, int]]) -> int:
    """crc32 of concatenated byte runs, from the (crc32, number of bytes) of each."""
    total = 0
    for crc, n in parts:
        total = _times_zeros(total, n) ^ crc
    return total


def token_digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from decoded blocks.

    ``start`` is the number of ids of all documents before it. A document that lies in several blocks is joined from
    the checksums of its parts, never from its ids in one task.
    """
    w = Window.partitionBy("file", "block").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = files.mapInArrow(_run_rows(False), _RUN)
    runs = runs.withColumn("in_block", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    runs = written(runs, "token-runs")
    blocks = files.select("file", "block", F.col("n_tokens").cast("long").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    # one row per file
    file_start = totals.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    starts = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start")).join(file_start, "file")
    starts = starts.select("file", "block", (F.col("block_start") + F.col("file_start")).alias("at"))
    placed = runs.join(starts, ["file", "block"]).withColumn("start", F.col("at") + F.col("in_block"))

    @F.pandas_udf("long")
    def joined(crcs, sizes):
        return crcs.combine(sizes, lambda c, n: join_crc32([(int(x), 4 * int(y)) for x, y in zip(c, n)]))

    # rows that share a doc_id are told apart by the start of their first part
    first = Window.partitionBy("file", "doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.withColumn("copy", F.sum((F.col("part") == 0).cast("int")).over(first))
    whole = whole.groupBy("file", "doc_id", "copy").agg(
        F.min("start").alias("start"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("start", "crc32", "n_tokens"))).alias("parts"),
    )
    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["crc32"]).otherwise(
        joined(F.col("parts.crc32"), F.col("parts.n_tokens"))
    )
    return whole.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))
