"""Linked vectors against all cosines."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from barloom.llm import cover_tree


def brute(rows, t):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and r[2] is not None and len(r[2]) > 0 and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    n, up = dict.fromkeys(ids, 0), {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = np.array(rows[a][2], float), np.array(rows[b][2], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    n[ids[a]] += 1
                    n[ids[b]] += 1
                    lo, hi = sorted((root(ids[a]), root(ids[b])))
                    up[hi] = lo
    return {i: (n[i], root(i), root(i) == i) for i in ids}


def vectors(seed, n=260, dim=8, noise=0.05):
    rng = np.random.default_rng(seed)
    rows, bases = [], rng.normal(size=(12, dim))
    for i in range(n):
        v = bases[rng.integers(12)] + noise * rng.normal(size=dim) if i % 3 else rng.normal(size=dim)
        rows.append((7 * i % 1009, int(rng.choice([1, 1, 1, 2])), (v * rng.choice([1, 3])).astype(np.float32).tolist()))
    copy = rows[4]
    rows += [(2000 + i, copy[1], copy[2]) for i in range(5)] + [(2100, copy[1], [2 * x for x in copy[2]])]
    rows += [(3000, None, copy[2]), (3001, 1, None), (3002, 1, [0.0] * dim), (3003, 1, [float("nan")] + [1.0] * (dim - 1))]
    rows += [(3004, 1, [None] + [1.0] * (dim - 1)), (3005, 1, [float("inf")] + [1.0] * (dim - 1)), (3006, 1, []), (3007, 1, [1.0, 2.0]), (3008, 1, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("leaf,seed,noise,t", [(1500, 1, 0.05, 0.98), (20, 2, 0.03, 0.98), (9, 3, 0.3, 0.9)])
def test_like_all_cosines(spark, monkeypatch, leaf, seed, noise, t):
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    monkeypatch.setattr(cover_tree, "FAN_OUT", 4)
    rows = vectors(seed, noise=noise)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(df.repartition(3), t).collect()}
    assert got == brute(rows, t)


def test_tree_covers_and_halves():
    x = cover_tree._unit(np.random.default_rng(0).normal(size=(300, 5)))
    tree = cover_tree.Tree(x)
    for node, kids in enumerate(tree.children):
        assert (tree.far(tree.centre[node], tree.members[node]) <= tree.radius[node] + 1e-7).all()
        if kids:
            assert sorted(np.concatenate([tree.members[k] for k in kids])) == sorted(tree.members[node])
            assert tree.centre[node] in [tree.centre[k] for k in kids]
            assert all(tree.radius[k] <= tree.radius[node] / 2 + 1e-9 or node == 0 for k in kids)


def test_empty_table(spark):
    assert cover_tree.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_vectors_of_a_node_are_assigned_together(monkeypatch):
    """One product for all vectors of a node in a batch; nodes may have centres of unlike number and length."""
    rng, calls, unit = np.random.default_rng(4), [], cover_tree._unit
    rows = [(i, rng.normal(size=4 + i % 2).tolist(), f"n{i % 2}") for i in range(60)]
    centres = {f"n{k}": unit(rng.normal(size=(3 + k, 4 + k))) for k in (0, 1)}
    columns = [pa.array(c) for c in zip(*rows)] + [pa.array([centres[r[2]].tolist() for r in rows])]
    monkeypatch.setattr(cover_tree, "_unit", lambda x: calls.append(len(x)) or unit(x))
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "embedding", "node", "centres"])
    (got,) = cover_tree._assigned(iter([batch]))
    gaps = [2 - 2 * centres[n] @ unit(np.array([v]))[0] for _, v, n in rows]
    assert got["child"].to_pylist() == [int(g.argmin()) for g in gaps] and calls == [30, 30]
    assert np.allclose(got["gap"].to_numpy(), [np.sqrt(max(0, g.min())) for g in gaps]) and "centres" not in got.schema.names


def test_small_leaves_are_compared_without_a_tree_of_single_vectors(monkeypatch):
    """Far vectors: a tree of single vectors would prune nothing and cost more than their cosines."""
    rng, trees = np.random.default_rng(5), []

    class Kept(cover_tree.Tree):
        def __init__(self, *args):
            super().__init__(*args)
            trees.append(self)

    monkeypatch.setattr(cover_tree, "Tree", Kept)
    x = rng.normal(size=(400, 16))
    x[7] = x[300] * 2
    both = pd.DataFrame({"second": np.arange(400) >= 200, "id": np.arange(400), "embedding": list(x), "copies": 1})
    got = cover_tree._compare(0.98)(("p", "q"), both)
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(7, 7, 1), (300, 7, 0), (300, 300, 1)]
    assert [len(t.centre) for t in trees] == [1, 1]
