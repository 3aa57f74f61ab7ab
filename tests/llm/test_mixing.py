"""The mix against sorting every source's documents by hash."""

import hashlib
import random
import re
from fractions import Fraction

import pytest

from barloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, key string, n int"


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Water filling in exact fractions, a source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in free}
        for s in above:
            out[s] = Fraction(most * sizes[s])
        budget -= sum(out[s] for s in above)
        free -= above
    return out


def brute(rows, **how):
    docs = [(d, t, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s, *_ in rows]
    sizes = {}
    for _, _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = targets(sizes, **how), []
    for s in sizes:
        whole = int(goal[s] // sizes[s]) if sizes[s] else 0
        left, held = goal[s] - whole * sizes[s], 0
        mark = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]} {r[1] or ''}".encode()).hexdigest()[:16]
        for d, _, _, n in sorted((r for r in docs if r[2] == s), key=mark):
            extra = n > 0 and left > 0 and (held + n <= left or held < left and held + n - left < left - held)
            held += n
            out.append((d, n, sizes[s], round(float(goal[s]), 6), n * (whole + extra)))
    return sorted(out, key=str)


def rows_of(seed, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        source = sources[0] if rng.random() < 0.4 else rng.choice(sources)
        words = [rng.choice(["a", "é", "x y", "-"]) for _ in range(rng.choice([0, 1, 3, 10, 40, 400]))]
        rows.append((i, rng.choice([" ", "\n\t", "  "]).join(words), source, "k", 0))
    rows += [(None, "a b c", "s1", "k", 0), (None, None, None, "k", 0), (None, "one of none", None, "k", 0), (900, "", "only empty", "k", 0), (901, None, None, "k", 0)]
    return rows + [(7, "same row " * 9, "s0", "k", 0)] * 25


@pytest.mark.parametrize("broadcast", [mixing.BROADCAST, 0])
@pytest.mark.parametrize("sources", [["s0", "s1", "é", "Z", "\U0001f600", "￮", "z"], ["s0"]])
def test_like_sorting(spark, monkeypatch, sources, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST", broadcast)
    rows = rows_of(len(sources), sources)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mixed(df, carry=["doc_id", "source"]).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)
    assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] for r in got)
    taken, goal, longest = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r["size"])
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1e-9 for s in taken)
    if broadcast:
        again = mixing.mixed(df.repartition(5), carry=["doc_id", "source"]).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("digits", [2, 8])
def test_levels_of_any_width(spark, monkeypatch, digits):
    monkeypatch.setattr(mixing, "DIGITS", digits)
    rows = rows_of(9, ["s0", "s1", "s2"])
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA), carry=["doc_id"]).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)


def test_nested_budgets(spark):
    """A larger share takes all that a smaller one takes."""
    df = spark.createDataFrame(rows_of(5, ["s0", "s1", "s2", "s3"]), SCHEMA)
    before = {}
    for share in (0.5, 1.4, 2.5):
        now = {(r.doc_id, r.text): r.copies for r in mixing.mixed(df.dropDuplicates(["doc_id", "text"]), share=share).collect()}
        assert all(now[k] >= n for k, n in before.items())
        before = now
    assert set(before.values()) == {0, 2} and all(n == 2 for (_, text), n in before.items() if text and text.split())


def test_mix_of_texts_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x", "k", 5), (2, "c", "y", "k", 6)], SCHEMA)
    plan = mixing.mixed(df)
    assert plan.columns == [*df.columns, "size", "source_size", "target", "copies", "taken"]
    mix = mixing.repeated(plan).collect()
    assert sorted((r.doc_id, r.text, r.n, r.copy) for r in mix) == sorted((r.doc_id, r.text, r.n, c) for r in plan.collect() for c in range(r.copies))
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    hollow = mixing.mixed(spark.createDataFrame([(1, None, None, None, None), (2, " ", "a", None, None)], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken) for r in hollow] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mixed(df.withColumnRenamed("n", "size"))


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(rows_of(1, ["s0", "s1"]), SCHEMA)
    plan = mixing.mixed(df, carry=["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
