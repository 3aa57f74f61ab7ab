"""Codes of vectors against plain integer k-means over all entries."""

import math

import numpy as np
import pytest

from barloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in e], lab) for i, e, lab, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for _, e, _ in kept), default=0) // parts)
    kept = [(i, e + [0] * (parts * width - len(e)), lab) for i, e, lab in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda e, p: e[p * width : (p + 1) * width]
    books = [[cut(e, p) for _, e, _ in order[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for _, e, _ in kept:
                taken.setdefault(near(cut(e, p), books[p])[1], []).append(cut(e, p))
            books[p] = [[sum(c) // len(taken[k]) for c in zip(*taken[k])] if k in taken else entry for k, entry in enumerate(books[p])]
    out = []
    for i, e, lab in kept:
        found = [near(cut(e, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    totals = {}
    for _, lab, _, d in out:
        totals[lab] = totals.get(lab, 0) + d
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted(((*r, totals[r[1]]) for r in out), key=key), books


def result(df):
    codes, books = df
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in codes.select("vec_id", "label", "code", "error", "label_error").collect()), key=key), books


@pytest.mark.parametrize("block,entries", [(2_048, 7), (3, 40), (1, 16)])
def test_like_plain_k_means(spark, monkeypatch, block, entries):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = np.random.default_rng(block)
    # few different numbers, so prefixes are shared, distances tie and entries stay unused
    vectors = (rng.integers(-3, 4, (90, 8)) / 1024).astype(np.float32).tolist()
    vectors += [vectors[0]] * 30 + rng.normal(size=(40, 8)).astype(np.float32).tolist()
    rows = [(200 - i, v, int(i % 3) or None, "x", 1) for i, v in enumerate(vectors)]
    want, books = brute(rows, entries=entries)
    got, own = result(vc.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries))
    assert got == want and own.tolist() == books
    assert vc.digest(own) == vc.digest(np.array(books))


def test_odd_vectors(spark):
    rows = [
        (1, [0.5, -0.5, 1.0], 1), (1, [0.5, -0.5, 1.0], 1), (1, [0.25] * 9, None), (None, [-0.0001] * 5, None), (None, None, 1), (4, [], 2),
        (5, [1.0, None], 2), (6, [float("nan")], 2), (7, [float("inf"), 1.0], 2), (8, [float("-inf")], None),
    ]
    rows = [(*r, "c", 0) for r in rows]
    want, books = brute(rows)
    got, own = result(vc.vector_codes(spark.createDataFrame(rows, SCHEMA)))
    assert got == want and len(got) == 5 and own.shape == (4, 5, 3) and own.tolist() == books


def test_empty_tables_and_bounds(spark):
    none = spark.createDataFrame([], SCHEMA)
    codes, books = vc.vector_codes(none)
    assert codes.count() == 0 and books.shape[1] == 0
    empty = spark.createDataFrame([(1, [], 1, "c", 0), (2, [], 1, "c", 0)], SCHEMA)
    assert result(vc.vector_codes(empty))[0] == [(1, 1, "00000000", 0, 0), (2, 1, "00000000", 0, 0)]
    with pytest.raises(ValueError):
        vc.vector_codes(none, entries=257)
    with pytest.raises(Exception, match="must stay below"):
        vc.vector_codes(spark.createDataFrame([(1, [1e9], 1, "c", 0)], SCHEMA))


def test_large_components_stay_exact():
    rng = np.random.default_rng(3)
    parts, book = (rng.integers(-vc.LARGEST, vc.LARGEST, s) for s in ((300, 16), (20, 16)))
    distinct, back = vc._ordered(parts)
    index, error = vc.nearest(distinct, book)
    full = ((parts[:, None].astype(object) - book.astype(object)) ** 2).sum(axis=2)
    assert (error[back] == full.min(axis=1)).all() and (index[back] == full.argmin(axis=1)).all()
