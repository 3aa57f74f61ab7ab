"""From rows that share a bucket key to verified links and connected groups, without all pairs of large buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, forest, written

#: Buckets of up to so many nodes give all their pairs; larger ones first give the pairs with their smallest node.
SMALL = 8
#: Rows of one bucket that a task holds at most; the rest of a larger bucket follows in parts.
HELD = 1_000_000
#: Nodes of a large bucket in one of its blocks; blocks are compared two at a time. Partners compared at once.
BLOCK, PARTNERS = 2_000, 1_024
#: Sum of the sizes of a block's nodes, about: buckets of large nodes have more blocks.
ROOM = 4_000_000
#: Pairs of a cell that are held before they are contracted to a forest.
HELD_PAIRS = 1_000_000

Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _pairs_of(key: np.ndarray, node: np.ndarray, mark: np.ndarray, span: np.ndarray, small: int, near: Near | None, open_first):
    """Pairs within runs of equal keys, and the rows of runs that are too large for all pairs."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    of = np.repeat(np.arange(len(first)), size)
    large = size > small
    lead, lead_mark, lead_span = node[first][of], mark[first][of], span[first][of]
    if open_first is not None and len(key) and open_first[0] == key[0]:
        lead[of == 0], lead_mark[of == 0], lead_span[of == 0] = open_first[1:]
        large[0] = True
    big = large[of]
    take = big & (lead != node)
    a, b, ma, mb, sa, sb = ([x[take]] for x in (lead, node, lead_mark, mark, lead_span, span))
    rest = np.flatnonzero(~big)
    for shift in range(1, small):
        rest = rest[rest + shift < len(key)]
        rest = rest[key[rest + shift] == key[rest]]
        if not len(rest):
            break
        a.append(node[rest]), b.append(node[rest + shift])
        ma.append(mark[rest]), mb.append(mark[rest + shift])
        sa.append(span[rest]), sb.append(span[rest + shift])
    a, b, ma, mb, sa, sb = (np.concatenate(x) for x in (a, b, ma, mb, sa, sb))
    if near is not None:
        ok = near(ma, mb, sa, sb)
        a, b = a[ok], b[ok]
    low, high = np.minimum(a, b), np.maximum(a, b)
    return low, high, key[big], node[big], mark[big], span[big]


def _scan(small: int, near: Near | None):
    """Walk rows sorted by key and node; kind 0: a pair, kind 1: (key, node, mark, span) of a large bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        open_first = None

        def out(key, node, mark, span):
            low, high, bk, bn, bm, bs = _pairs_of(key, node, mark, span, small, near, open_first)
            kind, blank = np.repeat(np.array([0, 1], np.int8), [len(low), len(bk)]), np.zeros(len(low), np.int64)
            cols = [kind, *(np.concatenate(x) for x in ((low, bk), (high, bn), (blank, bm), (blank, bs)))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "a", "b", "mark", "span"])

        def columns(batch):
            own = [batch[c].to_numpy() for c in batch.schema.names]
            return own + [np.zeros(batch.num_rows, np.int64)] * (4 - len(own))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, c]) for h, c in zip(held, columns(batch))]
            keep = np.ones(len(rows[0]), bool)
            keep[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [r[keep] for r in rows]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if len(rows[0]) - cut > HELD:
                key = rows[0][-1]
                lead = (key, *(r[cut] for r in rows[1:])) if open_first is None or open_first[0] != key else open_first
                if open_first is None or open_first[0] != key:
                    yield out(*(r[:cut] for r in rows))
                    open_first = lead
                    rows = [r[cut:] for r in rows]
                yield out(*rows)
                held = [r[-1:] for r in rows]
                continue
            if cut:
                yield out(*(r[:cut] for r in rows))
                open_first = None
            held = [r[cut:] for r in rows]
        if len(held[0]):
            yield out(*held)

    return run


def bucketed(rows: DataFrame, small: int = SMALL, near: Near | None = None) -> DataFrame:
    """kind, a, b, mark, span for rows (key, node, mark, span), all long: see ``_scan``. ``near`` drops pairs by marks
    and spans, which nodes bring along for that (rows may lack both)."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(_scan(small, near), "kind byte, a long, b long, mark long, span long")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (key, node, comp, size and others) of buckets, dealt into cells: two blocks of a bucket, or one with itself.

    Nodes are dealt over blocks by a hash, as many blocks as the bucket's rows and their sizes ask for, so a cell holds
    about two blocks however large the bucket is. Every pair of a bucket meets in the cell of its blocks.
    """
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / ROOM)).cast("int")
    parts = rows.groupBy("key").agg(parts.alias("parts"))
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("block")
    each = rows.join(parts, "key").select("*", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    own = [c for c in rows.columns if c != "key"]
    return each.select(cell.alias("key"), *own, "block", (F.col("block") == F.col("other")).cast("int").alias("alone"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that share the first column, which are next to each other, as one table each."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> Iterator[pa.Table]:
        key = table[0].to_numpy()
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
            yield table.slice(lo, hi - lo)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch[0].to_numpy()
        if key[0] == key[-1]:
            continue
        table = pa.Table.from_batches(held)
        last = table.num_rows - int((key == key[-1]).sum())
        yield from cut(table.slice(0, last).combine_chunks())
        held = table.slice(last).to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held).combine_chunks())


def sketches_of(table: pa.Table) -> np.ndarray:
    return table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)


def alike(
    comp: np.ndarray, size: np.ndarray, sketch: np.ndarray, limit: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of different components whose sketches differ in no more bits than allowed, some pairs at a time.
    ``comp`` may change in between; pairs that it has joined by then are left out."""
    for lo in range(0, len(comp), 64):
        a = slice(lo, lo + 64)
        for at in range(lo, len(comp), PARTNERS):
            b = slice(at, at + PARTNERS)
            far = np.bitwise_count(sketch[a, None, :] ^ sketch[None, b, :]).sum(2, dtype=np.int32)
            i, j = np.nonzero((far <= limit(size[a, None], size[None, b])) & (comp[a, None] != comp[None, b]))
            keep = lo + i < at + j
            yield lo + i[keep], at + j[keep]


def _cell_pairs(cell: pa.Table, limit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components in a cell whose sketches differ in no more bits than allowed. A cell of two
    blocks gives the pairs across them."""
    node, comp, size, block, alone = (cell[c].to_numpy() for c in ("node", "comp", "size", "block", "alone"))
    for i, j in alike(comp, size, sketches_of(cell), limit):
        keep = (block[i] != block[j]) | (alone[i] == 1)
        yield node[i[keep]], node[j[keep]]


def _cross(limit: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """All pairs of cells: see ``_cell_pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches):
            for a, b in _cell_pairs(cell, limit):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _trees(limit: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """(a, b) that join what the pairs of a cell connect: less rows than a cell has nodes, however many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches):
            a, b, held = [], [], 0
            for low, high in _cell_pairs(cell, limit):
                a.append(low), b.append(high)
                held += len(low)
                if held > HELD_PAIRS:
                    node, root = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [node], [root], 0
            if not sum(map(len, a)):
                continue
            node, root = forest(np.concatenate(a), np.concatenate(b))
            own = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], names=["a", "b"])

    return run


def groups(
    found: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sketches: Callable[[DataFrame], DataFrame],
    limit: Callable[[np.ndarray, np.ndarray], np.ndarray],
    joined: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) of all nodes with links, from written ``bucketed`` rows.

    ``verify`` keeps the true links among pairs (a, b). Nodes of a large bucket that its smallest node does not
    connect are then compared across components, two blocks of bounded size at a time: ``sketches`` gives (node, size, sketch: a list of longs) of the nodes asked for, and
    ``limit`` the most bits in which sketches of linked nodes of two sizes may differ. So every pair of a bucket is
    either connected or compared.

    With ``joined`` these pairs are no rows: it gets the families of nodes that they connect, each node in one, dealt
    into cells of their own (key, node, comp, size, block, alone), and gives true links that join what is linked in a cell.
    """
    # each node is first compared with the one it shares most buckets with; most other pairs are then connected already
    pairs = written(found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    likely = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    edges = written(verify(likely), "edges")
    comps = written(components(edges), "components")
    rest = pairs.select("a", "b").join(likely, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(comps.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    rest = rest.where("coalesce(a_in, a) <> coalesce(b_in, b)").select("a", "b")
    more = written(verify(rest), "edges")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        comps = written(components(edges), "components")
    big = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"))
    if big.isEmpty():
        return comps
    own = big.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed_keys = own.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    own = written(own.join(mixed_keys, "key"), "unconnected")
    if own.isEmpty():
        return comps
    rows = own.join(sketches(own.select("node").distinct()), "node")
    dealt = _cells(rows.select("key", "node", "comp", "size", "sketch")).repartition("key").sortWithinPartitions("key")
    if joined:
        families = components(dealt.mapInArrow(_trees(limit), "a long, b long")).withColumnRenamed("component", "key")
        more = joined(_cells(families.join(rows.select("node", "comp", "size").distinct(), "node")))
    else:
        more = verify(dealt.mapInArrow(_cross(limit), "a long, b long").distinct())
    more = written(more, "edges")
    return comps if more.isEmpty() else components(edges.unionByName(more))
