"""Periodic runs of words: harmonic-grid candidates, extended exactly by a recompression grammar."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.grammar import Level, extensions, mirrored, recompressed
from barloom.llm.words import Words, slices, split

#: Pairs that are extended at once, and places up to which grids are held ready; longer texts build theirs a period at a time.
TOGETHER, READY = 1 << 20, 1 << 16


def word_numbers(words: Words) -> np.ndarray:
    """Numbers of the words, equal for equal words and no others."""
    size = words.end - words.start
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[words.start] += 1
    mark[words.end] -= 1
    letters = words.data[np.cumsum(mark[:-1]).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return array.dictionary_encode().indices.to_numpy()


@lru_cache(maxsize=17)
def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(j - q, j) for every place j below n and every divisor q of j, by j: a stretch of period q that is at least two
    periods long holds such a pair."""
    period = np.arange(1, max(n, 2))
    times = (n - 1) // period
    q = np.repeat(period, times)
    j = q * (np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times) + 1)
    order = np.argsort(j, kind="stable")
    return (j - q)[order].astype(np.int32), j[order].astype(np.int32)


def _equal_pairs(ids: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid pairs of equal words in one text, as places."""
    n = len(ids)
    if n < least:
        return
    ready = min(n, READY)
    i, j = _grid(1 << max(ready - 1, 255).bit_length())
    m = int(np.searchsorted(j, ready))
    hit = np.flatnonzero(ids[i[:m]] == ids[j[:m]])
    hit = hit[j[hit] - i[hit] <= n // 2]
    yield i[hit].astype(np.int64), j[hit].astype(np.int64)
    for q in range(1, n // 2 + 1 if n > READY else 0):
        at = np.arange(-(-READY // q) * q, n, q)
        at = at[ids[at] == ids[at - q]]
        if len(at):
            yield at - q, at


def _joined(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """All texts as one sequence, each between marks of its own; begin of each text in it; and their grid pairs."""
    ids = word_numbers(words)
    texts = len(words.first) - 1
    begin = words.first[:-1] + np.arange(texts) + 1
    whole = np.empty(len(ids) + texts + 1, np.int64)
    word = np.ones(len(whole), bool)
    word[np.append(begin - 1, len(whole) - 1)] = False
    whole[word] = ids
    whole[~word] = int(ids.max(initial=-1)) + 1 + np.arange(texts + 1)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, rows = [], 0
        for at, lo, hi in zip(begin.tolist(), words.first[:-1].tolist(), words.first[1:].tolist()):
            for i, j in _equal_pairs(ids[lo:hi], least):
                for k in range(0, len(i), TOGETHER):
                    held.append((i[k : k + TOGETHER] + at, j[k : k + TOGETHER] + at))
                    rows += len(held[-1][0])
                    if rows >= TOGETHER:
                        yield tuple(np.concatenate(x) for x in zip(*held))
                        held, rows = [], 0
        if rows:
            yield tuple(np.concatenate(x) for x in zip(*held))

    return whole, begin, pairs()


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run a stretch, with its smallest period: a stretch found with a larger one has it as a divisor."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[fresh], end[fresh], period[fresh]


def runs_of(words: Words, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last, smallest period) of every run, by text, first word and period."""
    whole, begin, pairs = _joined(words, least)
    levels: list[Level] = []
    back: list[Level] = []
    none = np.zeros(0, np.int64)
    start, end, period = none, none, none
    n = len(whole)
    for i, j in pairs:
        if not levels:
            levels = recompressed(whole)
            back = mirrored(levels)
        q = j - i
        need = np.maximum(q, least - q)
        ahead = extensions(levels, i, j)
        # what is behind counts only where both sides together can be long enough: it is asked for all that go on
        behind = extensions(back, n - i, n - j)
        good = ahead + behind >= need
        found = ((i - behind)[good], (j + ahead)[good], q[good])
        start, end, period = _distinct(*(np.concatenate(x) for x in zip((start, end, period), found)))
    text = np.searchsorted(begin, start, side="right") - 1
    first, last = start - begin[text], end - begin[text]
    order = np.lexsort((period, first, text))
    return text[order], first[order], last[order], period[order]


def _texts_of(words: Words, keep: np.ndarray) -> list[bytes]:
    """Kept words of each text, joined by one space."""
    start, end = words.start[keep], words.end[keep]
    size = end - start + 1
    offset = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    source = np.repeat(start - offset[:-1], size) + np.arange(int(offset[-1]))
    gap = np.zeros(len(source), bool)
    gap[offset[1:] - 1] = True
    out = words.data[np.minimum(source, max(len(words.data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    out = np.where(gap, np.uint8(0x20), out)
    raw = out.tobytes()
    at = offset[np.concatenate([[0], np.cumsum(keep)])[words.first]].tolist()
    return [raw[lo : max(hi - 1, lo)] for lo, hi in zip(at[:-1], at[1:])]


def _found(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split(part["text"])
                text, first, last, period = runs_of(words, least)
                change = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(change, words.first[text] + first + period, 1)
                np.add.at(change, words.first[text] + last, -1)
                keep = np.cumsum(change[:-1]) == 0
                rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (first, last - first, period)], fields=list(run_type.value_type))
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part["rest"], pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), rows).cast(run_type), pa.array(_texts_of(words, keep), pa.binary()).cast(pa.string())],
                    names=["rest", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = 12, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row, n_words, runs (array of start, length, period) and collapsed (text).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of consecutive words with smallest period
    q, at least ``least`` words and two periods long, that no neighbouring word extends with period q. ``collapsed``
    keeps of each run the first q words and the words outside runs, joined by one space.

    Every row is judged by itself, so null and repeated ids and equal rows need no rule. Null and empty texts have no
    words, no runs and an empty collapsed text; no rows give no rows. Work and memory of a row follow its own length;
    rows are worked on some megabytes of text at a time.
    """
    made = {"n_words", "runs", "collapsed"}
    if made & set(carry):
        raise ValueError(f"carried columns clash with {sorted(made)}: {sorted(made & set(carry))}")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry), F.lit(0).alias("_")).alias("rest"), "text")
    kind = rows.schema["rest"].dataType.simpleString()
    found = rows.mapInArrow(_found(least), f"rest {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.select(*(F.col("rest").getField(c).alias(c) for c in carry), "n_words", "runs", "collapsed")


def looped(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text), with texts of a tenth of the ids made periodic from some word on.

    With h = crc32 of the decimal id and g = h div 10, where h mod 10 = 0: from word a = g mod n on, word i becomes
    word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Rows with null ids or without words stay as they are.
    """
    words: Column = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size(words)
    g = F.floor(h / 10)
    a = g % n
    rest = n - a
    p = 1 + F.floor(rest / (3 + g % 8))
    loop = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil(rest / p).cast("int")))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(loop, F.lit(1), rest.cast("int"))), " ")
    chosen = (h % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    return docs.select("doc_id", F.when(chosen, whole).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the text left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"),
        (-best["period"]).alias("period"), F.floor(best["length"] * 1000 / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
