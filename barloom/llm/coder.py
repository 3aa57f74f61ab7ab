"""Adaptive context-mixing range coder for blocks of ids below 65,536.

Every block starts from an empty model and is coded on its own. Numpy codes many blocks side by side: an array
operation handles the next id of all of them.

The id that followed the last two ids before (order 2) or the last one (order 1) is guessed, whichever has proved
right more often. A binary decision says if the guess is right; its probability mixes what order 2, order 1 and the
outcome of the last two guesses expect, in the logistic domain, with weights that each block learns. An id that was not
guessed is named by its place among the ids of the block so far or, if it is new there, by its value, both uniformly;
which of the two, the last two outcomes predict alone. There is no order-0 model of how often ids occur.
All arithmetic is on integers, so that every machine decodes what another has coded.
"""

from __future__ import annotations

import numpy as np

#: Values an id can take, and slots of the two context memories of a block.
IDS, SLOTS = 1 << 16, 1 << 10
_WORD = np.uint64(32)
_LEAST = np.uint64(1 << 32)
_MASK = np.uint64((1 << 32) - 1)

_p = (np.arange(4096) + 0.5) / 4096
#: Probability (of 4096) to log odds (by 256) and back; the table of the way back starts at -2048.
_STRETCH = np.round(np.log(_p / (1 - _p)) * 256).astype(np.int32)
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 1, 4095).astype(np.int32)


class _Model:
    """What the blocks have seen so far; writer and reader step it alike. Lanes are in order of falling length, so
    those still in work are the first ``m``."""

    def __init__(self, lanes: int) -> None:
        self.base = np.arange(lanes, dtype=np.int32) * SLOTS
        self.four = np.arange(lanes, dtype=np.int32) * 4
        self.last = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)
        self.after = [np.zeros(lanes * SLOTS, np.uint16) for _ in range(2)]
        self.trust = [np.zeros(lanes * SLOTS, np.uint8) for _ in range(2)]
        self.hit = [np.full(lanes * 4, 1024, np.int32) for _ in range(3)]
        self.weight = [np.full(lanes, 22_000, np.int32) for _ in range(3)]
        self.past = np.zeros(lanes, np.int32)
        self.again = np.full(lanes * 4, 2048, np.int32)
        self.known = np.zeros(lanes, np.int64)

    def guess(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The guessed id of each lane, and the probability of 4096 that it is right."""
        last = self.last[:m]
        self.slot = (
            self.base[:m] + ((last * 40503 >> 4) & (SLOTS - 1)),
            self.base[:m] + ((self.before[:m] * 31337 + last * 9973 >> 3) & (SLOTS - 1)),
        )
        self.trusted = [t[s] for t, s in zip(self.trust, self.slot)]
        self.told = [a[s] for a, s in zip(self.after, self.slot)]
        self.row = [self.four[:m] + self.trusted[0], self.four[:m] + self.trusted[1], self.four[:m] + self.past[:m]]
        self.expect = [_STRETCH[h[r]] for h, r in zip(self.hit, self.row)]
        x = sum(e * w[:m] for e, w in zip(self.expect, self.weight)) >> 16
        self.p = _SQUASH[np.minimum(np.maximum(x, -2048), 2047) + 2048]
        return np.where(self.trusted[1] >= self.trusted[0], self.told[1], self.told[0]).astype(np.int32), self.p

    def learn(self, m: int, right: np.ndarray, ids: np.ndarray) -> None:
        goal = right.astype(np.int32) << 12
        miss = (goal - self.p) * 6
        for h, r, e, w in zip(self.hit, self.row, self.expect, self.weight):
            old = h[r]
            h[r] = np.minimum(old + ((goal - old) >> 5), 4095)
            w[:m] += (e * miss + 32768) >> 16
        short = ids.astype(np.uint16)
        for a, t, s, told, trust in zip(self.after, self.trust, self.slot, self.told, self.trusted):
            t[s] = np.where(told == short, np.minimum(trust + 1, 3), trust >> 1)
            a[s] = short
        self.past[:m] = ((self.past[:m] << 1) & 3) | right
        self.before[:m] = self.last[:m]
        self.last[:m] = ids

    def seen(self, who: np.ndarray) -> np.ndarray:
        """Probability of 4096 that ids not guessed have been in the block before."""
        self.old_row = who.astype(np.int32) * 4 + self.past[who]
        return np.clip(self.again[self.old_row], 32, 4064)

    def learn_seen(self, who: np.ndarray, old: np.ndarray) -> None:
        p = self.again[self.old_row]
        self.again[self.old_row] = p + (((old.astype(np.int32) << 12) - p) >> 4)
        self.known[who[~old]] += 1


class _Writer:
    def __init__(self, lanes: int, room: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.out = np.zeros((lanes, room), "<u4")
        self.n = np.zeros(lanes, np.int64)

    def _shift(self, low: np.ndarray, wide: np.ndarray, lane: np.ndarray | None) -> None:
        """Put out the high word wherever the range has become short; a range across a word boundary is cut at it."""
        at = np.flatnonzero(wide < _LEAST)
        if len(at):
            lo, ra = low[at], wide[at]
            ra = np.where((lo ^ (lo + ra)) >= _LEAST, (~lo + np.uint64(1)) & _MASK, ra)
            to = at if lane is None else lane[at]
            self.out[to, self.n[to]] = lo >> _WORD
            self.n[to] += 1
            low[at], wide[at] = lo << _WORD, ra << _WORD

    def bit(self, who: np.ndarray | int, p: np.ndarray, yes: np.ndarray) -> None:
        """Code a decision of each lane of ``who`` (a number: the first so many) whose probability is p of 4096."""
        at = slice(0, who) if isinstance(who, int) else who
        low, wide = self.low[at], self.range[at]
        cut = (wide >> np.uint64(12)) * p.astype(np.uint64)
        low, wide = np.where(yes, low, low + cut), np.where(yes, cut, wide - cut)
        self._shift(low, wide, None if isinstance(who, int) else who)
        self.low[at], self.range[at] = low, wide

    def value(self, who: np.ndarray, value: np.ndarray, total: np.ndarray) -> None:
        part = self.range[who] // total.astype(np.uint64)
        low = self.low[who] + part * value.astype(np.uint64)
        self._shift(low, part, who)
        self.low[who], self.range[who] = low, part

    def finish(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        for _ in range(2):
            self.out[lane, self.n] = self.low >> _WORD
            self.n += 1
            self.low <<= _WORD
        return [row[:n].tobytes() for row, n in zip(self.out, self.n)]


class _Reader:
    def __init__(self, payloads: list[bytes]) -> None:
        self.data = np.zeros((len(payloads), max(map(len, payloads)) // 4 + 4), "<u4")
        for row, raw in zip(self.data, payloads):
            row[: len(raw) // 4] = np.frombuffer(raw, "<u4")
        self.n = np.full(len(payloads), 2, np.int64)
        self.low = np.zeros(len(payloads), np.uint64)
        self.range = np.full(len(payloads), (1 << 64) - 1, np.uint64)
        self.code = (self.data[:, 0].astype(np.uint64) << _WORD) | self.data[:, 1]

    def _shift(self, low: np.ndarray, wide: np.ndarray, lane: np.ndarray | None) -> None:
        at = np.flatnonzero(wide < _LEAST)
        if len(at):
            lo, ra = low[at], wide[at]
            ra = np.where((lo ^ (lo + ra)) >= _LEAST, (~lo + np.uint64(1)) & _MASK, ra)
            to = at if lane is None else lane[at]
            self.code[to] = (self.code[to] << _WORD) | self.data[to, self.n[to]]
            self.n[to] += 1
            low[at], wide[at] = lo << _WORD, ra << _WORD

    def bit(self, who: np.ndarray | int, p: np.ndarray) -> np.ndarray:
        at = slice(0, who) if isinstance(who, int) else who
        low, wide = self.low[at], self.range[at]
        cut = (wide >> np.uint64(12)) * p.astype(np.uint64)
        yes = self.code[at] - low < cut
        low, wide = np.where(yes, low, low + cut), np.where(yes, cut, wide - cut)
        self._shift(low, wide, None if isinstance(who, int) else who)
        self.low[at], self.range[at] = low, wide
        return yes

    def value(self, who: np.ndarray, total: np.ndarray) -> np.ndarray:
        part = self.range[who] // total.astype(np.uint64)
        value = (self.code[who] - self.low[who]) // part
        low = self.low[who] + part * value
        self._shift(low, part, who)
        self.low[who], self.range[who] = low, part
        return value.astype(np.int64)


def _places(blocks: list[np.ndarray], size: int) -> np.ndarray:
    """For each id its place among the distinct ids of its block so far, or -1 if it is new there."""
    out = np.full((len(blocks), size), -1, np.int32)
    for row, ids in zip(out, blocks):
        by_id = np.argsort(ids, kind="stable")
        new = np.ones(len(ids), bool)
        new[1:] = ids[by_id[1:]] != ids[by_id[:-1]]
        is_first = np.zeros(len(ids), bool)
        is_first[by_id[new]] = True
        rank = np.cumsum(is_first) - 1
        row[by_id] = np.repeat(rank[by_id[new]], np.diff(np.append(np.flatnonzero(new), len(ids))))
        row[: len(ids)][is_first] = -1
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks; they need not be equally long, and none is empty."""
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    blocks = [np.asarray(blocks[i], np.int32) for i in order]
    length = np.array([len(b) for b in blocks])
    size = int(length[0])
    ids = np.zeros((size, len(blocks)), np.int32)
    for k, b in enumerate(blocks):
        ids[: len(b), k] = b
    place = np.ascontiguousarray(_places(blocks, size).T)
    model, out = _Model(len(blocks)), _Writer(len(blocks), size * 2 + 8)
    active = np.searchsorted(-length, -np.arange(size), side="left")
    for t in range(size):
        m = int(active[t])
        guess, p = model.guess(m)
        now = ids[t, :m]
        right = guess == now
        out.bit(m, p, right)
        who = np.flatnonzero(~right)
        if len(who):
            at = place[t, who]
            old = at >= 0
            out.bit(who, model.seen(who), old)
            out.value(who, np.where(old, at, now[who]), np.where(old, model.known[who], IDS))
            model.learn_seen(who, old)
        # guessed ids may be new to the list: a slot that was never written guesses id 0
        new = np.flatnonzero(right & (place[t, :m] < 0))
        model.known[new] += 1
        model.learn(m, right, now)
    done: list[bytes] = [b""] * len(blocks)
    for i, raw in zip(order, out.finish()):
        done[i] = raw
    return done


def decode_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of blocks, from their payloads and numbers of ids."""
    order = np.argsort([-n for n in lengths], kind="stable")
    length = np.array(lengths)[order]
    size, lanes = int(length[0]), len(payloads)
    ids = np.zeros((size, lanes), np.int32)
    model, read = _Model(lanes), _Reader([payloads[i] for i in order])
    seen = np.zeros((lanes, size), np.uint16)
    had_zero = np.zeros(lanes, bool)
    active = np.searchsorted(-length, -np.arange(size), side="left")
    for t in range(size):
        m = int(active[t])
        now, p = model.guess(m)
        right = read.bit(m, p)
        who = np.flatnonzero(~right)
        if len(who):
            old = read.bit(who, model.seen(who))
            value = read.value(who, np.where(old, model.known[who], IDS))
            named = np.where(old, seen[who, np.where(old, value, 0)], value)
            now[who] = named
            fresh = who[~old]
            seen[fresh, model.known[fresh]] = named[~old]
            had_zero[fresh] |= named[~old] == 0
            model.learn_seen(who, old)
        new = np.flatnonzero(right & (now == 0) & ~had_zero[:m])
        seen[new, model.known[new]] = 0
        had_zero[new] = True
        model.known[new] += 1
        ids[t, :m] = now
        model.learn(m, right, now)
    done: list[np.ndarray] = [ids[:0, 0]] * lanes
    for i, k, n in zip(order, range(lanes), length):
        done[i] = ids[:n, k]
    return done
