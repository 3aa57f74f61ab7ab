"""A run-length grammar of a sequence by recompression, and longest common extensions on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from barloom.llm.common import mixed


@dataclass
class Level:
    """One sequence of symbols. ``up``: place of each in the next level; ``lead``: it is the first of its parent;
    ``down``: place of its own first child; ``stop``: end of its block of equal symbols, where the next level joins
    blocks, else None."""

    symbol: np.ndarray
    down: np.ndarray
    up: np.ndarray | None = None
    lead: np.ndarray | None = None
    stop: np.ndarray | None = None


def _named(*keys: np.ndarray) -> np.ndarray:
    """Dense numbers for rows of keys, equal for equal rows."""
    high = int(keys[1].max()) + 1
    return np.unique(keys[0].astype(np.int64) * high + keys[1], return_inverse=True)[1].astype(np.int32)


def recompressed(symbols: np.ndarray) -> list[Level]:
    """Levels from ``symbols`` up: blocks of equal symbols become one symbol, then pairs of a left and a right symbol
    do, until all symbols differ. Equal stretches are cut alike but for a few symbols at their ends."""
    levels = [Level(symbols.astype(np.int32), np.arange(len(symbols), dtype=np.int32))]
    salt = 0
    while True:
        now = levels[-1].symbol
        n = len(now)
        if n < 2 or int(now.max()) + 1 >= n and len(np.unique(now)) == n:
            return levels
        fresh = np.append(True, now[1:] != now[:-1])
        blocks = not fresh.all()
        if not blocks:
            salt += 1
            left = (mixed(now.astype(np.uint64) + np.uint64(salt << 40)) & np.uint64(1)).astype(bool)
            pair, turned = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
            pair = pair if pair.sum() >= turned.sum() else turned
            if not pair.any():
                continue
            fresh[1:] = ~pair
        first = np.flatnonzero(fresh).astype(np.int32)
        end = np.append(first[1:], n).astype(np.int32)
        levels[-1].up = (np.cumsum(fresh) - 1).astype(np.int32)
        levels[-1].lead = fresh
        if blocks:
            levels[-1].stop = end[levels[-1].up]
            above = _named(now[first], end - first)
        else:
            above = _named(now[first], np.where(end - first == 2, now[end - 1] + 1, 0))
        levels.append(Level(above, first))


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the sequence read backwards, from the same levels."""
    out = []
    for h, x in enumerate(levels):
        n = len(x.symbol)
        below = n if h == 0 else len(levels[h - 1].symbol)
        last = np.append(x.down[1:], below) - 1
        y = Level(x.symbol[::-1], (below - 1 - last)[::-1].astype(np.int32))
        if x.up is not None:
            y.up = (len(levels[h + 1].symbol) - 1 - x.up)[::-1]
            y.lead = np.append(x.lead[1:], True)[::-1]
            if x.stop is not None:
                y.stop = n - np.flatnonzero(x.lead)[x.up][::-1]
        out.append(y)
    return out


def _steps(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray | int:
    return np.minimum(level.stop[a] - a, level.stop[b] - b) if level.stop is not None else 1


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols are equal from places ``a`` and ``b`` on, for many pairs at once.

    Each pair climbs while both places begin a symbol of the next level, passing equal symbols in between, and then
    goes down again. The last symbol of the sequence must be the only one of its kind, and places of a pair differ.
    """
    start = a
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
    for level in levels:
        stopped = []
        climbed = []
        while len(who):
            same = level.symbol[a] == level.symbol[b]
            stopped.append((who[~same], a[~same], b[~same]))
            who, a, b = who[same], a[same], b[same]
            rise = level.lead[a] & level.lead[b] if level.lead is not None else np.zeros(len(a), bool)
            climbed.append((who[rise], a[rise], b[rise]))
            who, a, b = who[~rise], a[~rise], b[~rise]
            step = _steps(level, a, b)
            a, b = a + step, b + step
        waiting.append(tuple(np.concatenate(x) for x in zip(*stopped)) if stopped else (who, a, b))
        if climbed:
            who, a, b = (np.concatenate(x) for x in zip(*climbed))
        if level.up is not None:
            a, b = level.up[a].astype(np.int64), level.up[b].astype(np.int64)
    who, a, b = waiting[-1]
    for h in range(len(levels) - 1, 0, -1):
        below = levels[h - 1]
        a, b = levels[h].down[a].astype(np.int64), levels[h].down[b].astype(np.int64)
        while (same := np.flatnonzero(below.symbol[a] == below.symbol[b])).size:
            step = _steps(below, a[same], b[same])
            a[same] += step
            b[same] += step
        who, a, b = (np.concatenate(x) for x in zip((who, a, b), waiting[h - 1]))
    out = np.zeros(len(start), np.int64)
    out[who] = a
    return out - start
