"""Words and shingles of whole texts as 64-bit hashes, a slice of an Arrow column at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from barloom.llm.common import mixed

#: Bytes of text that are in work at once; a longer text is a slice of its own.
SLICE = 1 << 21

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case, and ASCII characters other than letters and digits as spaces.
_FOLDED = _LOWER.copy()
_FOLDED[[i for i in range(128) if not chr(i).isalnum()]] = 0x20


@dataclass
class Words:
    """Words of some rows: hash, first byte and the one after the last; ``first[i]:first[i+1]`` are the words of row i
    and ``edge[i]:edge[i+1]`` its bytes."""

    data: np.ndarray
    edge: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def split(texts: pa.Array, lower: bool = False, fold: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; a null has none. ``lower``: A-Z in lower case; ``fold``: also
    without ASCII punctuation, which then separates words."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower or fold:
        data = (_FOLDED if fold else _LOWER)[data]
    word = ~SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begin[edges] = word[edges]
    start = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    edges = at[1:][(at[1:] > 0)] - 1
    stop[edges] = word[edges]
    end = np.flatnonzero(stop) + 1
    first = np.searchsorted(start, at)
    return Words(data, at, start, end, first, _hash(data, word, start, end))


def _hash(data: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(offset, size)
    value = _BYTE[data[word]] * powers(_STEP, int(size.max()))[place]
    return mixed(np.add.reduceat(value, offset) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one row."""
    n = len(words.hash)
    out = np.zeros(n, np.uint64)
    if n >= k:
        w = powers(np.uint64(0xA24BAED4963EE407), k + 1)[1:]
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += words.hash[j : n - k + 1 + j] * w[j]
        out[: n - k + 1] = mixed(total)
    last = np.repeat(words.first[1:], np.diff(words.first))
    return out, np.arange(n) + k <= last


def shingle_sets(words: Words, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each row; fewer words: the whole sequence as one; none: empty."""
    hashes, _ = grams(words, k)
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        if hi - lo >= k:
            yield np.unique(hashes[lo : hi - k + 1])
        elif hi > lo:
            w = powers(np.uint64(0xA24BAED4963EE407), k + 1)[1:]
            whole = (words.hash[lo:hi] * w[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            yield mixed(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``SLICE`` bytes of text each."""
    if not batch.num_rows:
        return
    texts = batch[column].cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    part = (at[:-1] - at[0]) // SLICE
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the longs Spark knows."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
