"""Benchmark leaks against all windows in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import decontaminate


def words(text):
    return re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", text or "").lower().split(" ")


def plain(text):
    return [w for w in words(text) if w]


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items, percent=80):
    out = {}
    for d, text in docs.items():
        w = plain(text)
        for i, item in items.items():
            own = plain(item)
            want, best = grams(own), None
            for s in range(len(w) - len(own) + 1):
                if len(own) < 5:
                    break
                got = grams(w[s : s + len(own)])
                shared = sum((got & want).values())
                total = 2 * (len(own) - 4) - shared
                if 100 * shared >= percent * total and (best is None or shared / total > best[1]):
                    best = (s, shared / total)
            if best:
                out[d, i] = (best[0], len(own), round(best[1], 9))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "", "x"]) + "".join(rng.choice("abcdefg") for _ in range(4))
    say = lambda n: [word() for _ in range(n)]
    items = {i: " ".join(say(n)) for i, n in enumerate([5, 6, 9, 20, 30, 45, 45, 60])}
    items |= {100: None, 101: "", 102: "too short", 103: items[3], 104: "ab cd " * 15}
    docs = {}
    for d in range(50):
        w = say(rng.randrange(1, 60))
        i = rng.choice(list(items))
        passage = (items[i] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            if len(passage) > 12:
                passage[rng.randrange(len(passage))] = word()
        at = rng.randrange(len(w) + 1)
        w[at:at] = [p.upper() + "," if p.isascii() else p for p in passage] if d % 3 == 0 else passage
        docs[4 * d] = rng.choice([" ", "\n", "! "]).join(w)
    return docs | {1: None, 2: "", 3: " ".join(say(3000)) + " " + items[7], 5: "ab cd " * 400}, items


@pytest.mark.parametrize("block", [3, 500])
def test_like_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEMS", block)
    docs, items = made(block)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs.items()], "doc_id long, text string, item_id int, start string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, round(r.similarity, 9)) for r in decontaminate.contaminations(df.repartition(3), bench).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 25
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(docs) - {d for d, _ in want}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.contaminations(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert decontaminate.contaminations(one, bench.where("item_id = 2")).count() == 0
    assert decontaminate.decontaminated(one, bench.where("item_id = 2")).count() == 1


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 999, 30)) for _ in range(40)]
    items = decontaminate.Items.of(list(range(40)), texts)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 30, 400)]
    prints = items.prints[rng.integers(0, 40, 400)] ^ np.array(flips, np.uint64)
    far = np.bitwise_count(prints[:, None] ^ items.prints)
    which, item = items.near(prints)
    assert set(zip(which.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS))))


def test_short_items_and_documents_shorter_than_an_item(spark):
    long = " ".join(f"w{i}" for i in range(60))
    items = {1: long, 2: "Who is it?", 3: "who is it", 4: "solo", 5: "one two three four", 6: None, 7: "!"}
    docs = {1: " ".join(long.split()[:58]), 2: " ".join(long.split()[:40]), 3: "say who, is it who is it", 4: "who is", 5: "it one two three", 6: "a Solo; one two three four five", 7: None, 8: "who is\nit"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminations(df, bench, brief=True).collect()}
    assert got == {(1, 1, 0, 58, 54 / 56), (3, 2, 1, 3, 1.0), (3, 3, 1, 3, 1.0), (6, 4, 1, 1, 1.0), (6, 5, 2, 4, 1.0), (8, 2, 0, 3, 1.0), (8, 3, 0, 3, 1.0)}
    assert {r.doc_id for r in decontaminate.decontaminated(df, bench, brief=True).collect()} == {2, 4, 5, 7}
