"""Runs of words against a check of every period and place."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import periods
from barloom.llm.grammar import extensions, mirrored, recompressed
from barloom.llm.words import split


def brute(ws, least=12):
    found = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i + q < len(ws):
            k = i
            while k + q < len(ws) and ws[k] == ws[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, 2 * q):
                found.setdefault((i, k + q), q)
            i = k + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(rng, n, kinds):
    ws = [f"w{x}" for x in rng.integers(0, kinds, n)]
    for _ in range(int(rng.integers(0, 4))):
        if n:
            a, p, span = int(rng.integers(0, n)), 1 + int(rng.integers(0, 20)), int(rng.integers(0, 90))
            ws = [w if i < a or i > a + span else ws[a + (i - a) % p if a + (i - a) % p < n else i] for i, w in enumerate(ws)]
    return ws


@pytest.mark.parametrize("seed,least,ready,together", [(1, 12, 1 << 16, 1 << 20), (2, 1, 16, 7), (3, 5, 40, 100), (4, 12, 300, 1000)])
def test_like_every_period(monkeypatch, seed, least, ready, together):
    monkeypatch.setattr(periods, "READY", ready)
    monkeypatch.setattr(periods, "TOGETHER", together)
    rng = np.random.default_rng(seed)
    for _ in range(12):
        texts = [words_of(rng, int(rng.integers(0, 150)), int(rng.choice([1, 2, 3, 50]))) for _ in range(9)]
        words = split(pa.array([" ".join(t) if i != 4 else None for i, t in enumerate(texts)], pa.string()))
        text, first, last, period = periods.runs_of(words, least)
        for i, t in enumerate(texts):
            own = [(int(s), int(e - s), int(q)) for k, s, e, q in zip(text, first, last, period) if k == i]
            assert own == (brute(t, least) if i != 4 else [])


def test_extensions_both_ways():
    rng = np.random.default_rng(8)
    for kinds in (1, 2, 3, 20):
        body = rng.integers(0, kinds, 400)
        seq = np.concatenate([[kinds], body, body[:200], [kinds + 1], body[100:300], [kinds + 2]])
        levels = recompressed(seq)
        assert len(np.unique(levels[-1].symbol)) == len(levels[-1].symbol)
        i = rng.integers(1, len(seq) - 1, 800)
        j = rng.integers(1, len(seq) - 1, 800)
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        ahead = [next(k for k in range(len(seq)) if y + k >= len(seq) or seq[x + k] != seq[y + k]) for x, y in zip(i, j)]
        behind = [next(k for k in range(len(seq)) if x - k - 1 < 0 or seq[x - k - 1] != seq[y - k - 1]) for x, y in zip(i, j)]
        assert extensions(levels, i, j).tolist() == ahead
        assert extensions(mirrored(levels), len(seq) - i, len(seq) - j).tolist() == behind


def digest(doc, text):
    ws = (text or "").split(" ") if text else []
    ws = [w for w in ws if w]
    n, h = len(ws), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = brute(ws)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_query_digest_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(d, " ".join(words_of(rng, int(rng.integers(0, 200)), 30))) for d in range(70)]
    rows += [(None, None), (None, "a b " * 20), (3, "x " * 40), (3, "x " * 40), (75, ""), (76, " "), (77, "é ü é ü " * 8), (78, None)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, runs string").repartition(3)
    got = periods.run_digest(periods.periodic_runs(periods.looped(df))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(digest(d, t)) for d, t in rows)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_general_results(spark):
    df = spark.createDataFrame([(1, "a\tb a b\na b a b a b a b c", "keep")], "doc_id long, text string, lang string")
    (row,) = periods.periodic_runs(df, carry=("doc_id", "lang")).collect()
    assert (row.lang, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("keep", 13, [(0, 12, 2)], "a b c")
    assert periods.periodic_runs(df.where("doc_id = 0")).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(df.withColumnRenamed("lang", "runs"), carry=("runs",))


def test_one_very_long_text():
    """A text beyond the ready grids, all of one word but the middle."""
    n = 70_000
    words = split(pa.array([" ".join(["a"] * n + ["b"] + ["a", "c"] * 2_000)]))
    text, first, last, period = periods.runs_of(words)
    assert list(zip(first.tolist(), last.tolist(), period.tolist())) == [(0, n, 1), (n + 1, n + 4_001, 2)]
