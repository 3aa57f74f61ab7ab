"""Groups by shingle similarity against all pairs in plain Python."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import buckets, common, jaccard
from barloom.llm.common import bit_filter, components, passes


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * either:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}


def many_docs(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    docs, shared = [], [word() for _ in range(40)]
    for size in (1, 3, 5, 6, 7, 9, 12, 30, 64, 130, 260):
        for _ in range(3):
            base = [word() for _ in range(size)]
            docs.append(base)
            for _ in range(rng.randrange(5)):  # chains of copies, each near the one before
                base = list(base)
                for _ in range(max(1, size // 40)):
                    i = rng.randrange(len(base))
                    base[i : i + rng.choice([0, 1])] = rng.choice([[], [word()], [word(), word()]])
                docs.append(base)
    docs += [shared + [word() for _ in range(rng.randrange(1, 12))] for _ in range(25)]
    docs += [[word() for _ in range(8)] + shared for _ in range(12)]
    texts = [rng.choice([" ", "\n"]).join(d) for d in docs]
    texts += [None, "", " \t", "É é", "É É", texts[0], texts[5].upper(), texts[5], "x " * 500, "x " * 700]
    rng.shuffle(texts)
    return {3 * i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed,small", [(1, 8), (2, 2), (3, 3)])
def test_like_all_pairs(spark, monkeypatch, seed, small):
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    plain = buckets.bucketed
    monkeypatch.setattr(jaccard, "bucketed", lambda rows: plain(rows, small))
    docs = many_docs(seed)
    df = spark.createDataFrame([(d, t, "x", d) for d, t in docs.items()], "doc_id long, text string, node string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df.repartition(3)).collect()}
    assert got == brute(docs)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (0, "A b C")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_groups(df).collect())) == [(0, 1, 0), (1, 1, 0), (1, 1, 0)]


def test_null_and_repeated_ids(spark):
    """Rows are told apart by their texts, not by their ids."""
    say = [f"w{i}" for i in range(60)]
    near, other, far = say[:-1] + ["end"], [f"x{i}" for i in range(60)], [f"y{i}" for i in range(60)]
    rows = [(1, say), (None, near), (None, other), (7, other[:-1] + ["o"]), (7, far), (9, far), (None, ["alone"]), (None, None)]
    rows = [(d, " ".join(t) if t else None) for d, t in rows]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, 56, 1), (None, 56, 1), (None, 56, 7), (7, 56, 7), (7, 56, 7), (9, 56, 7), (None, 1, None), (None, 0, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pigeonhole_bounds():
    bands = jaccard.Bands(80)
    for a in range(1, 400):
        for b in range(-(-4 * a // 5), a + 1):
            apart = max(x for x in range(a + b + 1) if 100 * (a + b - x) >= 80 * (a + b + x)) if a + b < 60 else bands.apart(a, b)
            assert apart <= bands.apart(a, b)
            band = b.bit_length() - 1
            assert band in bands.of(a) and band in bands.of(b)
            assert min(bands.kept(a, band), bands.kept(b, band)) > bands.apart(a, b)
            assert bands.words(band) >= max(bands.kept(a, band), bands.kept(b, band))


@pytest.mark.parametrize("held", [4, 1_000_000])
def test_large_buckets_in_parts(monkeypatch, held):
    monkeypatch.setattr(buckets, "HELD", held)
    rng = np.random.default_rng(1)
    rows = sorted({(int(k), int(n)) for k, n in zip(rng.integers(0, 6, 90), rng.integers(0, 50, 90))})
    rows += [(9, n) for n in range(40)]
    key, node = (np.array(x) for x in zip(*rows))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 3]), pa.array(node[i : i + 3]), pa.array(node[i : i + 3] * 0)], names=["key", "node", "mark"]) for i in range(0, len(key), 3)]
    out = [tuple(r.values()) for b in buckets._scan(3, None)(iter(batches)) for r in b.to_pylist()]
    for k in set(key.tolist()):
        own = node[key == k].tolist()
        if len(own) <= 3:
            assert all((0, a, b, 0, 0) in out for a, b in combinations(own, 2))
        else:
            assert {(1, k, n, 0, 0) for n in own} <= set(out)
            assert {(0, own[0], n, 0, 0) for n in own[1:]} <= set(out)


def test_few_links_are_contracted_without_rounds(spark, monkeypatch):
    names, keep = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: (names.append(name), keep(df, name))[1])
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    got = [tuple(r) for r in components(df).collect()]
    assert dict(got) == want and len(got) == len(want) and len(names) == 1
    assert components(df.where("a = b")).collect() == []
    # more links than a task may hold go on in rounds
    monkeypatch.setattr(common, "LINKS_PER_TASK", 150)
    got = [tuple(r) for r in components(df).collect()]
    assert dict(got) == want and len(got) == len(want) and len(names) > 3


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def test_filter_lets_all_its_ids_through(spark):
    rng = np.random.default_rng(4)
    ids = rng.integers(-(1 << 62), 1 << 62, 500)
    df = spark.createDataFrame([(int(x),) for x in ids] * 2, "id long")
    held = bit_filter(df, 1 << 16)
    assert held.nbytes == 1 << 13 and passes(held, ids).all()
    assert passes(held, rng.integers(-(1 << 62), 1 << 62, 20_000)).mean() < 0.02
    assert not passes(bit_filter(df.where("id is null"), 1 << 16), ids).any()


def test_one_row_of_shingles_per_set_where_the_filter_is_full(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "bit_filter", lambda ids: np.full(1 << 17, -1, np.int64).view(np.uint64))
    held, keep = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: (held.append((name, out := keep(df, name))), out)[1])
    say = " ".join(f"w{i}" for i in range(60))
    docs = [(i, say + (" more" if i % 2 else "")) for i in range(20)]
    got = jaccard.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert [df.count() for name, df in held if name == "shingles"] == [2]


def test_pairs_of_large_buckets_are_no_rows(monkeypatch):
    """Sketches that are all alike join all nodes of a cell by one tree; sets tell which of them are linked."""
    monkeypatch.setattr(buckets, "HELD_PAIRS", 50)
    n, node = 60, np.arange(100, 160)
    sets = [np.arange(40, dtype=np.uint64) + np.uint64(1000 * (i % 3) + i // 30) for i in range(n)]
    raw = pa.array([s.tobytes() for s in sets], pa.binary())

    def cells_of(block, alone):
        columns = {"key": [5] * n, "node": node, "comp": node, "size": [40] * n, "block": block, "alone": [alone] * n}
        rows = {**{k: pa.array(v) for k, v in columns.items()}, "sketch": pa.array([[0] * 32] * n, pa.list_(pa.int64())), "shingles": raw}
        rows = pa.RecordBatch.from_pydict(rows)
        return iter([rows.slice(0, 25), rows.slice(25)])

    for block, alone in (([0] * n, 1), ([0] * 20 + [1] * 40, 0)):
        (tree,) = buckets._trees(jaccard.Bands(80).apart)(cells_of(block, alone))
        assert tree["a"].to_pylist() == node[1:].tolist() and set(tree["b"].to_pylist()) == {100}
        links = [tuple(r.values()) for b in jaccard._joined(80)(cells_of(block, alone)) for r in b.to_pylist()]
        assert len(links) == n - 3 and all(a < b and (a - b) % 3 == 0 for a, b in links)
