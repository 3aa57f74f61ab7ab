"""Line groups against all pairs of lines in plain Python."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import buckets, lines
from barloom.llm.common import mixed
from barloom.llm.words import split


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, percent=90, least=20):
    texts = {(d, no): lines.normalised(x) for d, t in docs.items() for no, x in enumerate((t or "").split("\n"))}
    kinds = sorted({x for x in texts.values() if len(x) >= least})
    marks = lines.simhash(kinds)
    up = {k: k for k in kinds}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, ma), (b, mb) in combinations(zip(kinds, marks), 2):
        if np.bitwise_count(ma ^ mb) <= lines.RADIUS and distance(a, b) <= max(len(a), len(b)) * (100 - percent) // 100:
            up[root(a)] = root(b)
    seen, out = set(), {}
    for d in sorted(docs):
        if docs[d] is None:
            out[d] = (None, 0, 0)
            continue
        kept, own = [], docs[d].split("\n")
        for no, x in enumerate(own):
            k = texts[d, no]
            if len(k) < least or root(k) not in seen:
                kept.append(x)
            if len(k) >= least:
                seen.add(root(k))
        out[d] = ("\n".join(kept), len(own), len(own) - len(kept))
    return out


@pytest.mark.parametrize("small", [8, 2])
def test_like_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 8)))
    bases = [[word() for _ in range(rng.choice([4, 9, 60, 60]))] for _ in range(25)]
    docs = {}
    for d in range(60):
        own = []
        for _ in range(rng.randrange(5)):
            base = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                base[rng.randrange(len(base))] = word()
            own.append(rng.choice([" ", "  "]).join(base).upper() if rng.random() < 0.2 else " ".join(base))
        docs[5 * d] = rng.choice(["\n", "\n\n"]).join(own)
    docs |= {1: None, 2: "", 3: "\n\n", 4: "short\nshort", 6: docs[10], 7: "z" * 30000, 8: "z" * 29999 + "y"}
    rows = [(d, t, "x", d) for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, no long").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()}
    want = brute({d: t for d, t in docs.items() if d not in (7, 8)})
    assert {d: got[d] for d in want} == want
    assert sum(w[2] for w in want.values()) > 40
    assert got[7][0] == docs[7]


def test_blocks_find_all_within_the_radius(spark):
    assert sum(bits for _, bits in lines.BLOCKS) == 64 and len(lines.BLOCKS) - lines.RADIUS == 2
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    marks = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(10):
            y = x
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                y ^= 1 << b
            marks.add(y)
    signed = [m - (1 << 64) if m >> 63 else m for m in sorted(marks)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(signed)], "line long, mark long").withColumn("span", F.lit(9).cast("long"))
    got = {(r.a, r.b) for r in buckets.bucketed(lines._blocks(df), 1000, lines._near(90)).where("kind = 0").collect()}
    own = sorted(marks)
    assert got == {(i, j) for i, j in combinations(range(len(own)), 2) if bin(own[i] ^ own[j]).count("1") <= 3}


def test_null_and_repeated_ids(spark):
    one = "the very same line stands in several of these rows here"
    near, own = one.replace("several", "severol"), "a line that only one of the rows has, and no other one"
    rows = [(1, one), (2, f"short\n{one}"), (2, f"short\n{own}"), (None, near), (None, f"{near}\nrest"), (None, own[::-1]), (3, None), (3, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near_found = lines.RADIUS >= np.bitwise_count(np.bitwise_xor(*lines.simhash([one, near])))
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(df).collect()), key=str)
    want = [(1, one, 0), (2, "short", 1), (2, f"short\n{own}", 0), (None, own[::-1], 0), (3, None, 0), (3, "", 1)]
    # of the two rows without an id that hold the other wording, one keeps it unless it is found to be like the first
    left = [r for r in got if r[0] is None and r[1] != own[::-1]]
    assert sorted((r for r in got if r not in left), key=str) == sorted(want, key=str)
    assert sum(r[2] for r in left) == (2 if near_found else 1) and sum(near in r[1] for r in left) == (0 if near_found else 1)


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edit_distances_of_what_lines_do_not_share(spark):
    """The limit holds as for whole lines, where they share an end, both, all or nothing."""
    rng = random.Random(8)
    pairs = [("", ""), ("", "a"), ("same line", "same line"), ("aa", "aaa"), ("abab" * 9, "abab" * 8), ("é" * 30, "é" * 29 + "ü"), ("x" + "y" * 20, "y" * 20 + "x")]
    for _ in range(300):
        x = [rng.choice("abé ") for _ in range(rng.randrange(1, 60))]
        y = list(x)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(2)] = [rng.choice("abcé") for _ in range(rng.randrange(3))]
        pairs.append(("".join(x), "".join(y)))
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select("x", "y", lines._within(F.col("x"), F.col("y"), 90).alias("near")).collect()
    want = [distance(x, y) <= max(len(x), len(y)) // 10 for x, y in pairs]
    assert [r.near for r in got] == want and 20 < sum(want) < 280


def test_fingerprints_of_lines_with_few_and_many_words():
    texts = ["", "one", " ".join(f"w{i}" for i in range(255)), " ".join(f"v{i % 700}" for i in range(1000)), "two two three"]
    held = lines._COUNTS.view(np.uint8).reshape(256, 8)
    assert held.tolist() == [[int(b) for b in f"{i:08b}"] for i in range(256)]
    for text, got in zip(texts, lines.simhash(texts)):
        words = split(pa.array([text]))
        kinds = np.unique(words.hash >> np.uint64(12))
        bits = np.unpackbits(mixed(kinds).view(np.uint8).reshape(-1, 8), axis=1)
        want = np.packbits(2 * bits.sum(0) > len(bits)).view(np.uint64)[0] if len(kinds) else 0
        assert got == want


def test_fingerprints_do_not_hash_what_sorts(monkeypatch):
    """numpy's unique puts integers into a hash table, half of all the time that fingerprints took."""
    texts = ["", "one two three", "one two two three", "three two one and more"]
    want = lines.simhash(texts)
    monkeypatch.setattr(np, "unique", None)
    assert lines.simhash(texts).tolist() == want.tolist() and want[1] == want[2] != want[3]
