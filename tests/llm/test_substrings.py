"""Repeated passages against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from barloom.llm import substrings
from barloom.llm.fm_index import FmIndex


def brute(docs, window):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in docs.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def random_docs(n, seed):
    rng = random.Random(seed)
    say = lambda k, v=60: " ".join(f"w{rng.randrange(v)}é" for _ in range(k))
    shared = [say(12) for _ in range(4)]
    docs = {}
    for i in range(n):
        parts = [say(rng.randrange(0, 12)), rng.choice(shared), say(rng.randrange(0, 9)), rng.choice([*shared, ""])]
        docs[i] = rng.choice([" ", "\n", " \t"]).join(parts)
    docs |= {n: None, n + 1: "", n + 2: " \n\t", n + 3: "ab cd " * 300, n + 4: "ab cd " * 300, n + 5: docs[0], n + 6: docs[0]}
    docs |= {n + 10: "tic " * 10 + say(30), n + 11: say(20) + " x y z" * 5}
    docs |= {n + 7: "one two three four five six seven", n + 8: "x\x0by", n + 9: say(4000, 10**6)}
    return docs


@pytest.mark.parametrize("split_over", [0, 3, 4000])
def test_like_counting_all_windows(spark, monkeypatch, split_over):
    monkeypatch.setattr(substrings, "SPLIT_OVER", split_over)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    monkeypatch.setattr(substrings, "LONGEST", 5 + split_over)
    docs = random_docs(60, split_over)
    rows = [(d, t, "x", d) for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, start long").repartition(4)
    assert result(substrings.remove_repeats(df, 8)) == brute(docs, 8)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    want = brute(docs, 35)
    assert result(substrings.remove_repeats(df)) == want and any(v[1] for v in want.values())


def test_index_counts_patterns():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n).astype(np.uint64) for n in (30, 1, 7, 90)]
    index = FmIndex(seqs, np.array([1, 1, 3, 1]), 4)
    text = [tuple(s.tolist()) for s in seqs]
    for k in range(1, 5):
        for s in text:
            for i in range(len(s) - k + 1):
                low, high = np.array([0]), np.array([len(index.text)])
                for w in reversed(s[i : i + k]):
                    low, high = index.extend(np.array([w + 1]), low, high)
                count = sum(wt * sum(t[j : j + k] == s[i : i + k] for j in range(len(t) - k + 1)) for t, wt in zip(text, (1, 1, 3, 1)))
                assert index.weight[high[0]] - index.weight[low[0]] == count
    assert pd.Series([len(f) for f in index.repeats()]).tolist() == [27, 0, 4, 87]


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    say = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    texts = [(None, say(0, 20)), (7, say(500, 5) + " " + say(0, 20)), (3, say(100, 30)), (3, say(200, 30)), (4, say(110, 20)), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(dict(enumerate(t for _, t in texts)), 8)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df, 8).collect())
    assert got == sorted((d or -1, *want[i]) for i, (d, _) in enumerate(texts))


def test_passages_that_share_only_their_anchor_are_not_stored(spark, monkeypatch):
    """Texts with one phrase in common, but no window: their words are not moved."""
    tables = {}
    real = substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    say = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    docs = {i: f"{say(1000 * i, 10)} {say(8 * (i % 10), 8)} {say(1000 * i + 20, 10)}" for i in range(1, 41)}
    docs |= {50: say(90000, 60), 51: "x " + say(90000, 40) + " y"}
    got = result(substrings.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), 12))
    assert got == brute(docs, 12) and got[51][1] == 40
    assert tables["passages"].join(tables["places"], ["row", "start"], "left_anti").count() > 0
    assert {r.row for r in tables["places"].collect()} == {r.row for r in tables["rows"].where("doc_id >= 50").collect()}
