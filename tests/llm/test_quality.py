"""Held-out accuracy, the optimum of the descent, and edge cases of the classifier."""

import zlib

import numpy as np

from barloom.llm import quality

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{SMALL}/documents.parquet"), labels).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, y in own if y], [s for s, _, y in own if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([p == y for _, p, y in own]) > 0.93


def test_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(quality, "PASSES", 400)
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, rng.integers(0, 12))).astype(np.int32) for _ in range(60)]
    good = np.array([len(r) > 0 and r[0] % 2 == 0 for r in rows])
    ratio = quality.log_count_ratios(rows, good)
    w = quality.dual_descent(rows, good, ratio)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(max(1, len(r)))
        x[i, 30] = 1
    y = np.where(good, 1, -1)
    bound = 0.5 / np.array([(~good).mean(), good.mean()])[good.astype(int)]
    cost = lambda v: 0.5 * v @ v + (bound * np.maximum(0, 1 - y * (x @ v))).sum()
    own = np.append(w[:30] / np.where(ratio[:30] == 0, 1, ratio[:30]), w[-1])
    best = min(cost(own + 0.01 * rng.normal(size=31) * rng.random()) for _ in range(3000))
    assert cost(own) <= best + 1e-3


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "abc " * 30000, 0.1), (None, "x", 0.2), (1, "y", 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality(docs, none).collect()
    assert len(rows) == 5 and {round(r.score, 6) for r in rows} == {0.5} and {r.held_out for r in rows if r.doc_id is None} == {False}
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1), (99, 0)], "doc_id long, quality int")
    assert {round(r.score, 5) for r in quality.quality(docs, odd).collect()} == {round(1 - 1e-6, 5)}
    assert quality.quality(docs.where("doc_id = 77"), odd).count() == 0
    kept = quality.good_rows(docs, none, 0.4)
    assert kept.columns == docs.columns and kept.count() == 5


def test_only_labels_in_use_and_only_a_bounded_sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()), 60)
    again = quality.train(docs.repartition(5), labels.where(~quality.held_out()).repartition(3), 60)
    assert (model == again).all() and model.any()
