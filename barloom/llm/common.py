"""Written intermediate tables and connected components, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import scratch_folder

#: Links that one task contracts at once.
LINKS_PER_TASK = 250_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, where their names cannot clash with any that operators add."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("rest"))


def whole(df: DataFrame, columns: list[str]) -> DataFrame:
    """Undo ``aside``: the given columns, in their order."""
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns))


def bit_filter(ids: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A filter of fixed size over a column of longs: one bit of ``bits`` for each. What it holds is bounded by
    ``bits``, not by the ids; the more there are, the more others it lets through."""
    (name,) = ids.columns
    at = ids.select(F.pmod(F.col(name), F.lit(bits)).alias("at")).distinct()
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.collect():
        out[r.word] = r.mask
    return out.view(np.uint64)


def passes(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter lets through: all it was made of, and few others."""
    at = (ids % (len(held) * 64)).astype(np.uint64)
    return (held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node each of them reaches within this array."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        while (hop := root[root]).tobytes() != root.tobytes():
            root = hop
        if root.tobytes() == before.tobytes():
            return nodes, nodes[root]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace edges by (node, smallest node reached), in pieces of bounded size."""
    held, rows = [], 0

    def done() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, roots = forest(a, b)
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])

    for batch in batches:
        held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        rows += batch.num_rows
        if rows > 1_000_000:
            yield done()
            held, rows = [], 0
    if rows:
        yield done()


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node reached) of all nodes, from edges that one task may hold."""
    held = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches if batch.num_rows]
    if held:
        nodes, roots = forest(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges ``a``-``b`` (long); component: smallest node reached.

    Tasks first contract the edges they happen to hold, then as many edges as one task may hold (``LINKS_PER_TASK``).
    Where that takes more than one task, alternating large-star and small-star rounds follow. Every round is joins and
    grouped minima on a table written to the shared folder. Hot nodes only ever cost a grouped minimum.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = written(links.mapInArrow(_local_forest, "a long, b long"), "links")
    tasks = -(-links.count() // LINKS_PER_TASK)
    if tasks < 2:
        return links.coalesce(1).mapInArrow(_rooted, "node long, component long")
    links = written(links.coalesce(tasks).mapInArrow(_local_forest, "a long, b long").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        # large star: neighbours above a node move to its smallest neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: neighbours below a node, and the node itself, move to the smallest of them
        moved = moved.distinct()
        low = moved.groupBy("a").agg(F.min("b").alias("m"))
        moved = moved.join(low, "a")
        links = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            moved.select("a", F.col("m").alias("b"))
        )
        links = written(links.where("a <> b").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
