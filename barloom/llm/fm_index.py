"""Compressed FM-index over sequences of word codes: wavelet tree, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """Bit vector of packed words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletTree:
    """Rank over a sequence of codes below 2**levels, one bit vector a level (in matrix layout)."""

    def __init__(self, codes: np.ndarray, levels: int) -> None:
        self.levels = []
        for b in range(levels - 1, -1, -1):
            bit = (codes >> b & 1).astype(bool)
            self.levels.append((b, _Bits(bit), int(len(codes) - bit.sum())))
            codes = np.concatenate([codes[~bit], codes[bit]])
        self.start = np.searchsorted(codes_order(codes, levels), codes_order(np.arange(1 << levels), levels))

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each code occurs before each position i."""
        base = self.start[code]
        for b, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(code >> b & 1, zeros + ones, i - ones)
        return i - base


def codes_order(codes: np.ndarray, levels: int) -> np.ndarray:
    """Where a code stands after the last level: by its bits from the lowest to the highest."""
    out = np.zeros(len(codes), np.int64)
    for b in range(levels):
        out = out << 1 | (codes >> b & 1)
    return out


class FmIndex:
    """Index of sequences with weights (how many sequences of the corpus a stored one stands for).

    Suffixes are sorted by their first ``depth`` codes at least, which is all that counts of shorter patterns need.
    """

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, depth: int) -> None:
        size = np.array([len(s) for s in sequences])
        self.first = np.concatenate([[0], np.cumsum(size + 1)])
        words, code = np.unique(np.concatenate(sequences), return_inverse=True)
        n = int(self.first[-1])
        text = np.zeros(n, np.int64)  # 0 ends a sequence
        inside = np.ones(n, bool)
        inside[self.first[1:] - 1] = False
        text[inside] = code + 1
        self.text, self.size, self.depth = text, size, depth
        order, self.shorter = _suffixes(text, depth)
        before = text[order - 1]
        self.total = np.searchsorted(np.sort(text), np.arange(len(words) + 2))
        self.tree = WaveletTree(before, max(1, int(len(words)).bit_length()))
        of = np.repeat(np.arange(len(size)), size + 1)[order]
        self.weight = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[of])])

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with the code and go on like those in [low, high)."""
        start = self.total[code]
        return start + self.tree.rank(code, low), start + self.tree.rank(code, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share their first depth - 1 codes with the one at ``low``."""
        at = np.searchsorted(self.shorter, low, side="right")
        return self.shorter[at - 1], np.append(self.shorter, len(self.text))[at]

    def repeats(self) -> list[np.ndarray]:
        """For each stored sequence, whether the ``depth`` codes from each place on occur more than once.

        Matching statistics, cut off at ``depth``: all sequences are streamed from their ends side by side; a match
        is extended to the left and, at full length, its last code dropped before the next step.
        """
        order = np.argsort(-self.size, kind="stable")
        often = np.zeros(len(self.text), bool)
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), len(self.text), np.int64)
        for step in range(int(self.size.max(initial=0))):
            m = int(np.searchsorted(-self.size[order], -step, side="left"))
            own = order[:m]
            place = self.size[own] - 1 - step
            at = self.first[own] + place
            low[:m], high[:m] = self.extend(self.text[at], low[:m], high[:m])
            if step + 1 >= self.depth:
                often[at] = self.weight[high[:m]] - self.weight[low[:m]] > 1
                low[:m], high[:m] = self.shorten(low[:m])
        return [often[a : a + max(0, n - self.depth + 1)] for a, n in zip(self.first, self.size)]


def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first codes, and where runs with equal first depth - 1 codes begin."""
    n, rank, k = len(text), text, 1
    at = {}
    while k < depth:
        at[k] = rank
        key = rank * (int(rank.max()) + 1)
        key[: max(0, n - k)] += rank[k:] if k < n else 0
        _, rank = np.unique(key, return_inverse=True)
        k *= 2
    order = np.argsort(rank, kind="stable")
    half = max(h for h in at if h <= depth - 1)
    a = at[half][order]
    later = order + depth - 1 - half
    b = np.where(later < n, at[half][np.minimum(later, n - 1)], -1)
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)
