"""Quality scores of documents: naive Bayes support vectors over hashed character sequences."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import slices

#: Labelled documents that the classifier is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 6_000
#: Hashed features, the first 64 of them left to forms of repetition; lengths of the byte sequences.
FEATURES, LENGTHS = 1 << 17, (2, 3, 4)
#: Passes of the dual coordinate descent, its upper bound of a multiplier, and parts for calibration.
PASSES, BOUND, PARTS = 8, 1.0, 3

_CODE = np.random.default_rng(77).integers(0, 1 << 63, (max(LENGTHS), 256), dtype=np.uint64) | np.uint64(1)


def _repeats(text: bytes) -> list[int]:
    """Word sequences of the form x x, whatever x is: indicators of how many there are and of their share."""
    words = text.split()
    n = sum(map(eq, words, words[1:]))
    share = 10 * n // max(1, len(words) - 1)
    return [*range(n.bit_length()), *range(32, 32 + share)]


def features(text: bytes) -> np.ndarray:
    """Numbers of the byte sequences and forms of repetition in a text, whatever their count; an empty text has none."""
    data = np.frombuffer(text, np.uint8)
    found = []
    for n in LENGTHS:
        if len(data) >= n:
            code = np.full(len(data) - n + 1, n, np.uint64)
            for j in range(n):
                code = code * np.uint64(0x9E3779B97F4A7C15) + _CODE[j][data[j : len(data) - n + 1 + j]]
            found.append(np.maximum(code >> np.uint64(64 - 17), np.uint64(64)))
    mark = np.zeros(FEATURES, bool)
    for code in found:
        mark[code.astype(np.int64)] = True
    mark[_repeats(text)] = True
    return np.flatnonzero(mark).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each feature in good and bad rows."""
    p, q = np.ones(FEATURES), np.ones(FEATURES)
    for row, g in zip(rows, good):
        (p if g else q)[row] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights, the last of them the bias, of the linear classifier with least hinge loss over scaled indicators.

    A row's indicators are scaled by the ratios and to a length that does not depend on how many there are. The rarer
    class gets a larger bound, so that both weigh the same.
    """
    y = np.where(good, 1.0, -1.0)
    share = np.array([(~good).mean(), good.mean()])
    bound = BOUND * 0.5 / np.maximum(share[good.astype(int)], 1e-9)
    value = [ratio[r] / np.sqrt(len(r)) if len(r) else ratio[r] for r in rows]
    norm = np.array([v @ v + 1.0 for v in value])
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(5)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)).tolist():
            r, v = rows[i], value[i]
            slope = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    return np.append(w * ratio, bias)


def margin(row: np.ndarray, weights: np.ndarray) -> float:
    return float(weights[row].sum() / np.sqrt(len(row)) + weights[-1]) if len(row) else float(weights[-1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def calibrated(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to the probability of a good row."""
    n1, n0 = good.sum(), (~good).sum()
    goal = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * margins + b)
        h = p * (1 - p) + 1e-9
        grad = np.array([((p - goal) * margins).sum(), (p - goal).sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Weights, bias, slope and offset. Margins for the calibration come from parts that did not see the row. With
    rows of one class only, or none, every score is the share of good rows (a half without rows)."""
    if not len(rows) or good.all() or not good.any():
        share = np.clip(good.mean() if len(rows) else 0.5, 1e-6, 1 - 1e-6)
        return np.concatenate([np.zeros(FEATURES + 1), [1.0, np.log(share / (1 - share))]])
    part, margins = np.arange(len(rows)) % PARTS, np.zeros(len(rows))
    for k in range(PARTS):
        own = [r for r, p in zip(rows, part) if p != k]
        seen = good[part != k]
        if seen.all() or not seen.any():
            continue
        w = dual_descent(own, seen, log_count_ratios(own, seen))
        for i in np.flatnonzero(part == k):
            margins[i] = margin(rows[i], w)
    return np.concatenate([dual_descent(rows, good, log_count_ratios(rows, good)), calibrated(margins, good)])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on at most ``rows`` labelled documents, whole texts. ``labels``: doc_id, quality (1 good, 0 bad; other
    values and null ids are left out; of several labels of a document the largest counts). One task fits; the bound is
    what it holds."""
    use = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = [features((t or "").encode()).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["quality"], pa.array(raw, pa.binary())], names=["doc_id", "quality", "raw"])

    # the sample is at most ``rows`` short rows
    texts = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").select("doc_id", F.col("quality").cast("int"), "text")
    seen = texts.mapInArrow(numbers, "doc_id long, quality int, raw binary")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "raw"])
        model = fit([np.frombuffer(x, np.int32) for x in group["raw"]], group["quality"].to_numpy() == 1)
        return pd.DataFrame({"model": [model.tobytes()]})

    got = seen.groupBy().applyInPandas(fitted, "model binary").first()
    return np.frombuffer(got["model"], np.float64) if got else fit([], np.zeros(0, bool))


def _scores(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    weights, slope, offset = model[:-2], model[-2], model[-1]
    return _sigmoid(slope * np.array([margin(features((t or "").encode()), weights) for t in texts.to_pylist()]) + offset)


def scored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, score: from 0 to 1 for every whole text; null and empty texts score what the bias alone says."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = pa.array(_scores(part["text"], held.value))
                yield pa.RecordBatch.from_arrays([part["doc_id"], score], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double")


def good_rows(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more; the model sees no held-out label."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_scores(part["text"], held.value) >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: every document, scored by a model that saw no held-out label.

    held_out: crc32 of the id as text leaves 2 when divided by 4. predicted is 1 from ``least`` on. A null doc_id
    is not held out. Only the text is an input of the score.
    """
    model = train(docs, labels.where(~held_out()))
    return scored(docs, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
