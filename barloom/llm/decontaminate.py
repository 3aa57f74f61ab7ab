"""Benchmark items in documents: SimHash of item-sized windows, multi-index Hamming search, exact similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.words import Words, grams, slices, split

#: Items that are searched together; a larger benchmark is searched in blocks of so many.
ITEMS = 500
#: Bits in which the fingerprints of a window and an item may differ. Of four 16-bit blocks one then differs in at
#: most a quarter of them.
RADIUS = 19
#: Words of a shingle.
SHINGLE = 5

_NEAR = np.array(
    sorted(sum(1 << b for b in bits) for n in range(RADIUS // 4 + 1) for bits in combinations(range(16), n)), np.uint16
)


def fingerprints(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the shingles ``start[i]`` to ``start[i] + size[i]``, each weighted by how often it occurs."""
    if not len(start):
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    votes = total[start + size] - total[start]
    return np.packbits(2 * votes > size[:, None], axis=1).view(np.uint64).ravel()


@dataclass
class Items:
    """Benchmark items of at least five words, and the multi-index of their fingerprints; shorter items, if asked for,
    as (hash of all words, item_id) by their number of words."""

    ids: np.ndarray
    words: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray
    every: np.ndarray
    cuts: np.ndarray
    rows: np.ndarray
    brief: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], brief: bool = False) -> Items:
        w = split(pa.array(texts, pa.string()), fold=True)
        hashes, _ = grams(w, SHINGLE)
        size = np.diff(w.first)
        use = np.flatnonzero(size >= SHINGLE)
        start, n = w.first[:-1][use], size[use] - SHINGLE + 1
        own = [np.sort(hashes[a : a + k]) for a, k in zip(start, n)]
        prints = fingerprints(hashes, start, n)
        # for each block and value, the items whose block differs from it in few bits
        blocks = prints.view(np.uint16).reshape(-1, 4) if len(prints) else np.zeros((0, 4), np.uint16)
        keys = (np.arange(4)[None, :, None] << 16) + (blocks[:, :, None] ^ _NEAR)
        keys = keys.reshape(-1)
        rows = np.repeat(np.arange(len(use), dtype=np.int32), 4 * len(_NEAR))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=4 << 16))]).astype(np.int64)
        every = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        few = {}
        for n in range(1, SHINGLE) if brief else ():
            if len(which := np.flatnonzero(size == n)):
                at = grams(w, n)[0][w.first[:-1][which]]
                by = np.argsort(at, kind="stable")
                few[n] = at[by], np.array(ids, np.int64)[which[by]]
        return cls(np.array(ids, np.int64)[use], size[use], own, prints, every, cuts, rows[np.argsort(keys, kind="stable")], few)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a fingerprint, item) for all items within the radius."""
        blocks = prints.view(np.uint16).reshape(-1, 4)
        keys = ((np.arange(4) << 16) + blocks).ravel()
        n = self.cuts[keys + 1] - self.cuts[keys]
        which = np.repeat(np.repeat(np.arange(len(prints)), 4), n)
        at = np.repeat(self.cuts[keys] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        item = self.rows[at]
        close = np.bitwise_count(prints[which] ^ self.prints[item]) <= RADIUS
        both = np.unique(which[close].astype(np.int64) * len(self.ids) + item[close])
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))


def _similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Shared and total weight of two sorted lists of shingles, each weighted by how often it occurs."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared, len(a) + len(b) - shared


def _find(texts: pa.Array, items: Items, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(row, item_id, first word, words, similarity) of the best window of each item in each row."""
    w = split(texts, fold=True)
    return sorted(_brief(w, items) + _long(w, items, percent))


def _brief(w: Words, items: Items) -> list[tuple[int, int, int, int, float]]:
    """The first place of each item of fewer than five words, word for word."""
    out = []
    for n, (known, ids) in items.brief.items():
        hashes, inside = grams(w, n)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(inside & (known[at] == hashes))
        if not len(hit):
            continue
        row = w.row[hit]
        _, first = np.unique(np.stack([row.astype(np.uint64), hashes[hit]]), axis=1, return_index=True)
        for k in first.tolist():
            r, h = int(row[k]), hashes[hit[k]]
            same = ids[np.searchsorted(known, h) : np.searchsorted(known, h, side="right")]
            out += [(r, i, int(hit[k] - w.first[r]), n, 1.0) for i in np.unique(same).tolist()]
    return out


def _within(w: Words, hashes: np.ndarray, count: np.ndarray, items: Items, percent: int) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, words, similarity) of items that have more words than a row: the row is the window."""
    size = np.diff(w.first)
    kinds = np.unique(items.words)
    # a row of k shingles shares at most k with an item of more
    most = (size - SHINGLE + 1) * 100 // percent + SHINGLE - 1
    some = np.searchsorted(kinds, size, side="right") < np.searchsorted(kinds, most, side="right")
    for r in np.flatnonzero((size >= SHINGLE) & some).tolist():
        a, k = int(w.first[r]), int(size[r]) - SHINGLE + 1
        if 100 * (count[a + k] - count[a]) < percent * k:
            continue
        for i in np.flatnonzero((items.words > size[r]) & (items.words <= most[r])).tolist():
            shared, total = _similarity(hashes[a : a + k], items.shingles[i])
            if 100 * shared >= percent * total:
                yield r, i, int(size[r]), shared / total


def _long(w: Words, items: Items, percent: int) -> list[tuple[int, int, int, int, float]]:
    hashes, inside = grams(w, SHINGLE)
    at = np.minimum(np.searchsorted(items.every, hashes), max(0, len(items.every) - 1))
    hit = inside & (items.every[at] == hashes) if len(items.every) else np.zeros(len(hashes), bool)
    if not hit.any():
        return []
    count = np.concatenate([[0], np.cumsum(hit)])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for r, i, n, v in _within(w, hashes, count, items, percent):
        key = r, int(items.ids[i])
        best[key] = max(best.get(key, (v, 0, n)), (v, 0, n))
    row = w.row
    starts, sizes = [], []
    for n in np.unique(items.words).tolist():
        k = n - SHINGLE + 1
        # a similar window shares most of its shingles with an item: others need no fingerprint
        first = np.arange(0, max(0, len(hashes) - n + 1))
        ok = (count[first + k] - count[first]) * 100 >= percent * k
        first = first[ok]
        first = first[row[first] == row[first + n - 1]]
        starts.append(first), sizes.append(np.full(len(first), n))
    start, size = np.concatenate(starts), np.concatenate(sizes)
    # windows of one neighbourhood share the running sums of their bits
    order = np.argsort(start, kind="stable")
    start, size = start[order], size[order]
    for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start) > 4096) + 1) if len(start) else ():
        lo, hi = int(start[part[0]]), int((start[part] + size[part]).max())
        prints = fingerprints(hashes[lo:hi], start[part] - lo, size[part] - SHINGLE + 1)
        which, item = items.near(prints)
        same = items.words[item] == size[part][which]
        for s, i in zip(start[part][which[same]].tolist(), item[same].tolist()):
            n = int(items.words[i])
            shared, total = _similarity(hashes[s : s + n - SHINGLE + 1], items.shingles[i])
            if 100 * shared >= percent * total:
                key, r = (int(row[s]), int(items.ids[i])), (shared / total, -s, n)
                best[key] = max(best.get(key, r), r)
    return [(r, i, -s - int(w.first[r]), n, v) for (r, i), (v, s, n) in sorted(best.items())]


def _item_blocks(benchmark: DataFrame, brief: bool):
    """The items in blocks of bounded size, in order of their ids."""
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    ids, texts = [], []
    for r in rows.toLocalIterator():
        ids.append(r.item_id), texts.append(r.text)
        if len(ids) == ITEMS:
            yield Items.of(ids, texts, brief)
            ids, texts = [], []
    if ids:
        yield Items.of(ids, texts, brief)


def contaminations(docs: DataFrame, benchmark: DataFrame, percent: int = 80, brief: bool = False) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the best window of each benchmark item found in each document.

    Words are compared in lower case (A-Z) and without ASCII punctuation. A window has as many words as the item; it is
    found if its fingerprint differs from the item's in at most ``RADIUS`` bits and if the five-word shingles of both,
    weighted by how often they occur, have 100 * shared >= percent * total. ``start`` counts such words of
    the document from 0. A document with fewer words than the item is one window, whatever its fingerprint. Items of
    one to four words are found word for word if ``brief``, else not. Documents without a find have no row; null and
    empty texts have none, null items are not searched. Other columns are not looked at.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start int, n_words int, similarity double"
    found = spark.createDataFrame([], schema)
    for block in _item_blocks(benchmark, brief):
        items = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    rows = _find(part["text"], items.value, percent)
                    row, item, start, n, v = zip(*rows) if rows else ((),) * 5
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"].cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(v, pa.float64())],
                        names=["doc_id", "item_id", "start", "n_words", "similarity"],
                    )

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(search, schema))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, brief: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``contaminations`` finds nothing. Nothing is moved between tasks."""
    for block in _item_blocks(benchmark, brief):
        items = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in _find(part["text"], items.value, percent)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
