"""Linked vectors by dual traversal of cover trees: exact pairs above a cosine threshold within a label.

Unit vectors at a chord of at most sqrt(2 - 2 t) have a cosine of at least t, and chords obey the triangle inequality,
so bounds on them prune. The upper levels of a label's tree are Spark tables of nodes; a leaf of theirs holds at most
``LEAF`` vectors and is the root of a cover tree built inside a task, down to single vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, forest, written

#: Vectors of a leaf of the upper levels; children of a node there, drawn from so many of its vectors.
LEAF, FAN_OUT, DRAWN = 1_500, 12, 400
#: Vectors of a node that a task's tree does not split; two such nodes are compared by one matrix product.
DIRECT = 512
#: Slack for rounding in pruning bounds; cosines themselves are compared in double precision.
SLACK = 1e-6


class Tree:
    """Cover tree of the rows of ``x`` (unit vectors): nested levels whose radii halve.

    Level k is a list of nodes; a node is a centre (one of the vectors, also a centre of every level below), the vectors
    assigned to it, which lie within the level's radius, and its covering radius, the farthest of them. Nodes of up to
    ``whole`` vectors are not split.
    """

    def __init__(self, x: np.ndarray, whole: int = 1) -> None:
        self.x = x
        self.centre = [0]
        self.members = [np.arange(len(x))]
        self.radius = [float(self.far(0, self.members[0]).max())]
        self.children: list[list[int]] = [[]]
        todo = [(0, self.radius[0])]
        while todo:
            node, bound = todo.pop()
            rest = self.members[node]
            if len(rest) <= whole or self.radius[node] == 0.0:
                continue
            bound /= 2
            centre = self.centre[node]
            while len(rest):
                gap = self.far(centre, rest)
                near = gap <= bound
                near |= rest == centre
                own = rest[near]
                self.centre.append(int(centre))
                self.members.append(own)
                self.radius.append(float(gap[near].max()))
                self.children.append([])
                self.children[node].append(len(self.centre) - 1)
                todo.append((len(self.centre) - 1, min(bound, self.radius[-1])))
                rest = rest[~near]
                centre = rest[0] if len(rest) else -1

    def far(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x[rows] @ self.x[centre])))


def dual(p: Tree, q: Tree, raw_p: np.ndarray, raw_q: np.ndarray, w_p: np.ndarray, w_q: np.ndarray, t: float):
    """Links between the vectors of two trees, or of one with itself: how many each has, vectors counted by their
    weights, and edges that connect those that are linked.

    Node pairs that their covering radii keep apart are dropped; pairs that lie wholly within the threshold are counted
    as a whole; small pairs, and those down to single vectors, are compared by cosine.
    """
    same, limit = p is q, float(np.sqrt(2.0 - 2.0 * t))
    n_p, n_q = np.zeros(len(p.x), np.int64), np.zeros(len(q.x), np.int64)
    norm_p, norm_q = np.sqrt((raw_p * raw_p).sum(1)), np.sqrt((raw_q * raw_q).sum(1))
    centres = np.array(p.centre), np.array(q.centre)
    radius = np.array(p.radius), np.array(q.radius)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def opened(u: np.ndarray, v: np.ndarray, once: bool):
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p.x[centres[0][u]] @ q.x[centres[1][v]].T)))
        reach = radius[0][u][:, None] + radius[1][v]
        near = gap - reach <= limit + SLACK
        if once:
            near &= u[:, None] <= v
        a, b = np.nonzero(near)
        return zip(u[a].tolist(), v[b].tolist(), (gap + reach <= limit - SLACK)[a, b].tolist())

    todo = list(opened(np.array([0]), np.array([0]), False))
    while todo:
        i, j, inside = todo.pop()
        own, other, once = p.members[i], q.members[j], same and i == j
        if inside or len(own) * len(other) <= 64 * 64 or not (p.children[i] or q.children[j]):
            if inside:
                n_p[own] += w_q[other].sum()
                n_q[other] += 0 if once else w_p[own].sum()
                edges += [(own, np.full(len(own), other[0])), (np.full(len(other), own[0]), other)]
            else:
                linked = (raw_p[own] @ raw_q[other].T) / (norm_p[own][:, None] * norm_q[other]) >= t
                n_p[own] += linked @ w_q[other]
                n_q[other] += 0 if once else w_p[own] @ linked
                a, b = np.nonzero(linked)
                edges.append((own[a], other[b]))
            continue
        split_p = bool(p.children[i]) and (once or p.radius[i] >= q.radius[j] or not q.children[j])
        split_q = bool(q.children[j]) and (once or not split_p)
        u = np.array(p.children[i] if split_p else [i])
        v = np.array(q.children[j] if split_q else [j])
        todo.extend(opened(u, v, once))
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*edges)) if edges else (none, none)
    return (n_p + n_q, n_q) if same else (n_p, n_q), a.astype(np.int64), b.astype(np.int64)


def _doubles():
    """Components in double precision, negative zeros as zeros."""
    return F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))


def _distinct(vectors: DataFrame) -> DataFrame:
    """(id, label, embedding, copies): one row per different usable vector of a label, named by its smallest vec_id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select("vec_id", "label", _doubles().alias("embedding")).where("label is not null and embedding is not null")
    rows = rows.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pivots(group: pd.DataFrame) -> pd.DataFrame:
    """Centres of a node's children, each the farthest from those before, among vectors drawn from it."""
    x = _unit(_matrix(group["embedding"]))
    order = np.argsort(group["id"].to_numpy(), kind="stable")
    chosen, gap = [int(order[0])], np.full(len(x), np.inf)
    while len(chosen) < min(FAN_OUT, len(x)):
        gap = np.minimum(gap, 2.0 - 2.0 * (x @ x[chosen[-1]]))
        nxt = int(gap.argmax())
        if gap[nxt] <= 1e-12:
            break
        chosen.append(nxt)
    return pd.DataFrame({"node": [group["node"].iloc[0]], "centres": [[x[c].tolist() for c in chosen]]})


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The child of each vector: that with the nearest centre."""
    for batch in batches:
        child, gap = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        nodes = batch["node"].dictionary_encode()
        of = nodes.indices.to_numpy()
        for k in range(len(nodes.dictionary)):
            own = np.flatnonzero(of == k)
            x = _unit(batch["embedding"].take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
            far = 2.0 - 2.0 * (x @ np.array(batch["centres"][int(own[0])].as_py()).T)
            child[own], gap[own] = far.argmin(1), np.sqrt(np.maximum(0.0, far.min(1)))
        names = [c for c in batch.schema.names if c != "centres"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(child), pa.array(gap)], names=[*names, "child", "gap"])


_ROW = "id long, embedding array<double>, copies long, node string"


def upper_levels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as (id, embedding, copies, node), and all nodes (node, parent, centre, radius, n, leaf).

    Level by level: nodes with more than ``LEAF`` vectors are cut at centres drawn from a bounded number of their
    vectors; every vector goes to the nearest. A node that does not fall apart is cut by ids.
    """
    root = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    open_ = rows.select("id", "embedding", "copies", root.alias("node"))
    open_ = written(open_, "tree-level")
    sizes = open_.groupBy("node").agg(F.count("*").alias("n"))
    leaves, nodes, level = None, None, 0
    # roots reach everything: their radius is that of the sphere
    sizes = written(sizes.select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("radius"), "n"), "tree-nodes")
    while True:
        level += 1
        marked = sizes.withColumn("leaf", F.col("n") <= LEAF)
        nodes = marked if nodes is None else nodes.unionByName(marked)
        done = open_.join(marked.where("leaf").select("node"), "node", "left_semi")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = marked.where("not leaf").select("node", "n")
        if large.isEmpty():
            return leaves, nodes
        rest = open_.join(large, "node")
        # a hash of the id draws about DRAWN vectors of each node
        drawn = rest.where(F.pmod(F.xxhash64("id", F.lit(level)), F.greatest(F.lit(1).cast("long"), (F.col("n") / DRAWN).cast("long"))) == 0)
        pivots = drawn.select("node", "id", "embedding").groupBy("node").applyInPandas(_pivots, "node string, centres array<array<double>>")
        pivots = written(pivots, "tree-centres")
        to = rest.join(pivots, "node").select("id", "embedding", "copies", "node", "centres")
        to = written(to.mapInArrow(_assigned, _ROW + ", child int, gap double"), "tree-level")
        spread = to.groupBy("node").agg(F.count_distinct("child").alias("kinds"))
        to = to.join(spread, "node").withColumn("child", F.when(F.col("kinds") > 1, F.col("child")).otherwise(F.pmod(F.xxhash64("id"), F.lit(FAN_OUT)).cast("int")))
        to = to.withColumnRenamed("node", "parent").withColumn("node", F.concat_ws("/", "parent", F.col("child").cast("string")))
        sizes = to.groupBy("node", "parent", "child").agg(F.max("gap").alias("radius"), F.count("*").alias("n"), F.max("kinds").alias("kinds"))
        sizes = sizes.join(pivots.withColumnRenamed("node", "parent"), "parent")
        centre = F.get("centres", F.when(F.col("kinds") > 1, F.col("child")).otherwise(0))
        sizes = written(sizes.select("node", "parent", centre.alias("centre"), "radius", "n"), "tree-nodes")
        open_ = written(to.select("id", "embedding", "copies", "node"), "tree-level")


def _leaf_pairs(nodes: DataFrame, limit: float) -> DataFrame:
    """Pairs (p, q), p <= q, of leaves that covering radii do not keep apart: node pairs are opened level by level."""
    nodes = written(nodes, "tree-nodes")
    pairs = nodes.where("parent is null").select(F.col("node").alias("p"), F.col("node").alias("q"))
    done = None
    while True:
        for end in ("p", "q"):
            info = nodes.select(F.col("node").alias(end), F.col("leaf").alias(f"{end}_leaf"))
            pairs = pairs.join(info, end)
        ready = pairs.where("p_leaf and q_leaf").select("p", "q")
        done = ready if done is None else done.unionByName(ready)
        pairs = pairs.where("not (p_leaf and q_leaf)")
        if pairs.isEmpty():
            return done
        # both ends are opened; a leaf stands for itself
        for end in ("p", "q"):
            below = nodes.where("parent is not null").select(F.col("parent").alias(end), F.col("node").alias("x"), F.col("centre").alias("c"), F.col("radius").alias("r"))
            itself = nodes.where("leaf").select(F.col("node").alias(end), F.col("node").alias("x"), F.col("centre").alias("c"), F.col("radius").alias("r"))
            opened = below.unionByName(itself).select(end, F.col("x").alias(f"{end}_x"), F.col("c").alias(f"{end}_c"), F.col("r").alias(f"{end}_r"))
            pairs = pairs.join(opened, end)
        gap = F.sqrt(F.aggregate(F.zip_with("p_c", "q_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        near = F.col("p_c").isNull() | F.col("q_c").isNull() | (gap - F.col("p_r") - F.col("q_r") <= limit + SLACK)
        pairs = pairs.where(near).select(F.least("p_x", "q_x").alias("p"), F.greatest("p_x", "q_x").alias("q")).distinct()
        pairs = written(pairs, "tree-pairs")


def _compare(t: float):
    """Links of the vectors of one pair of leaves: rows with a = b count links, others are edges."""

    def run(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        parts = [both] if same else [both[~both["second"]], both[both["second"]]]
        raw = [_matrix(x["embedding"]) for x in parts]
        trees = [Tree(_unit(x), DIRECT) for x in raw]
        ids = [x["id"].to_numpy() for x in parts]
        copies = [x["copies"].to_numpy() for x in parts]
        k = len(parts) - 1
        counts, a, b = dual(trees[0], trees[k], raw[0], raw[k], copies[0], copies[k], t)
        a, b = ids[0][a], ids[k][b]
        node, root = forest(a[a != b], b[a != b])
        out = [pd.DataFrame({"a": node[node != root], "b": root[node != root], "n": 0})]
        out += [pd.DataFrame({"a": own[n > 0], "b": own[n > 0], "n": n[n > 0]}) for own, n in zip(ids, counts)]
        return pd.concat(out).astype("int64")

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold`` (above 0). Null or zero vectors and those with null or non-finite components link with nothing. n_links counts
    the other vectors linked directly, copies included; component_id is the smallest vec_id reachable; kept marks
    vectors that are their own component_id. Vectors of different lengths do not link. vec_id must be
    distinct; a repeated row counts as a copy. Other columns are not looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and not above 1")
    rows = written(_distinct(vectors), "vectors")
    leaves, nodes = upper_levels(rows)
    pairs = written(_leaf_pairs(nodes, float(np.sqrt(2.0 - 2.0 * threshold))).distinct(), "leaf-pairs")
    ends = pairs.select("p", "q", F.col("p").alias("node"), F.lit(False).alias("second"))
    ends = ends.unionByName(pairs.where("p <> q").select("p", "q", F.col("q").alias("node"), F.lit(True).alias("second")))
    both = ends.join(leaves, "node").select("p", "q", "second", "id", "embedding", "copies")
    found = both.groupBy("p", "q").applyInPandas(_compare(threshold), "a long, b long, n long")
    found = written(found, "vector-links")
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comps = components(found.where("a <> b").select("a", "b"))
    named = rows.join(links, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    named = named.select("label", "embedding", (F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = vectors.select("vec_id", "label", _doubles().alias("embedding")).join(named, ["label", "embedding"], "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
