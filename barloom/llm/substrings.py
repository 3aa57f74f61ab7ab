"""Repeated passages: FM-index shards that are streamed with the passages that can repeat, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bit_filter, mixed, passes, written
from barloom.llm.fm_index import FmIndex
from barloom.llm.words import SPACE, Words, grams, powers, signed, slices, split

#: Words of an anchor, words of stored passages in one shard, different passages around an anchor before they are cut
#: into single windows, and windows of a passage; where an anchor is repeated for longer, several passages follow.
ANCHOR, SHARD_WORDS, SPLIT_OVER, LONGEST = 5, 400_000, 4_000, 128


def _runs(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages: first word, number of windows and anchor.

    The anchor of a window is the smallest hash of its five-word sequences; neighbouring windows with equal anchors
    form a passage. Equal windows have equal anchors wherever they stand.
    """
    n, span = len(hashes), window - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64)
    low, width = hashes, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    windows = n - window + 1
    low = low[:windows]
    row = words.row
    inside = row[:windows] == row[window - 1 :]
    fresh = np.ones(windows, bool)
    fresh[1:] = (low[1:] != low[:-1]) | (row[1:windows] != row[: windows - 1])
    starts = np.flatnonzero(fresh & inside)
    ends = np.flatnonzero(np.append(fresh, True) | np.append(~inside, True))
    stop = ends[np.searchsorted(ends, starts, side="right")]
    size, anchor = stop - starts, low[starts]
    parts = -(-size // LONGEST)
    part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, size, anchor = (np.repeat(x, parts) for x in (starts, size, anchor))
    return starts + part * LONGEST, np.minimum(size - part * LONGEST, LONGEST), anchor


def _anchors_at(hashes: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the anchor in a passage. Only where they differ its windows can equal each other."""
    span = window - ANCHOR + 1
    each = np.arange(span)
    last = start + windows - 1
    left = start + (hashes[start[:, None] + each] == anchor[:, None]).argmax(1)
    right = last + span - 1 - (hashes[last[:, None] + each[::-1]] == anchor[:, None]).argmax(1)
    return left, right


class _Contents:
    """Hash of ``size`` words from ``start`` on, the same wherever they stand."""

    def __init__(self, words: Words) -> None:
        base = np.uint64(0xD1342543DE82EF95)
        n = len(words.hash)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * powers(base, n), dtype=np.uint64)])
        self.back = powers(np.uint64(pow(int(base), -1, 1 << 64)), n)

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        return mixed((self.total[start + size] - self.total[start]) * self.back[start] + np.asarray(size, np.uint64))


def _sides(contents: _Contents, start: np.ndarray, windows: np.ndarray, at: np.ndarray, window: int) -> tuple[pa.Array, pa.Array]:
    """Hashes of the anchor with the words on its left, and with those on its right; null where a passage ends before.

    A window has half of its other words at least on one side of its anchor, so a passage whose anchor stands in it
    once shares a window with another one only if it also shares the hash of one side.
    """
    half = (window - ANCHOR + 1) // 2
    sides = []
    for first, whole, tag in ((at - half, at - start >= half, 0), (at, start + windows - 1 + window - at >= ANCHOR + half, 1)):
        hashes = np.zeros(len(start), np.uint64)
        hashes[whole] = contents(first[whole], ANCHOR + half) ^ np.uint64(tag)
        sides.append(pa.array(hashes.view(np.int64), mask=~whole))
    return sides[0], sides[1]


def _anchors(window: int):
    """(anchor, again) of the passages; again: the anchor stands more than once in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split(part["text"])
                hashes, _ = grams(words, ANCHOR)
                start, windows, anchor = _runs(words, hashes, window)
                at, last = _anchors_at(hashes, start, windows, anchor, window)
                yield pa.RecordBatch.from_arrays([signed(anchor), pa.array(at != last)], names=["anchor", "again"])

    return run


def _passages(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split(part["text"])
                hashes, _ = grams(words, ANCHOR)
                start, windows, anchor = _runs(words, hashes, window)
                row = words.row[start]
                contents = _Contents(words)
                at, _ = _anchors_at(hashes, start, windows, anchor, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(anchor),
                        signed(contents(start, windows + window - 1)),
                        part["row"].take(pa.array(row)),
                        pa.array((start - words.first[row]).astype(np.int32)),
                        pa.array(windows.astype(np.int32)),
                        *_sides(contents, start, windows, at, window),
                    ],
                    names=["anchor", "content", "row", "start", "windows", "left", "right"],
                )

    return run


def _stored(window: int):
    """The words of the passages that stand for their copies; widely shared anchors as single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split(part["text"])
                contents, rows = _Contents(words), []
                for k, wanted in enumerate(part["wanted"].to_pylist()):
                    for p in wanted:
                        at = words.first[k] + p["start"]
                        if p["split"]:
                            one = np.arange(at, at + p["windows"])
                            keys = contents(one, window).view(np.int64).tolist()
                            steps = [(key, i, words.hash[at + i : at + i + window]) for i, key in enumerate(keys)]
                        else:
                            steps = [(p["content"], 0, words.hash[at : at + p["windows"] + window - 1])]
                        for key, i, w in steps:
                            home = key if p["split"] else p["anchor"]
                            rows.append((home, key, p["anchor"], p["content"], i, p["n"], w.tobytes()))
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _UNIT_SCHEMA)], schema=_UNIT_SCHEMA
                )

    return run


_UNIT_SCHEMA = pa.schema(
    [("home", pa.int64()), ("key", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("words", pa.binary())]
)
_UNIT = "home long, key long, anchor long, content long, at int, n long, words binary"


def _spans(flags: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word spans [from, to) that the flagged windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b) + window - 1) for a, b in zip(edge[::2], edge[1::2])]


def _search(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        index = FmIndex([np.frombuffer(w, np.uint64) for w in group["words"]], group["n"].to_numpy(), window)
        spans = [_spans(f, window) for f in index.repeats()]
        found = pd.DataFrame({"home": group["home"], "key": group["key"], "spans": spans})
        return found[found["spans"].str.len() > 0]

    return run


def _mark():
    return F.xxhash64("row")


def _through(held, inside: bool):
    """The rows whose mark a filter lets through, or the others, which are none of those it was made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(held.value, batch["mark"].to_numpy()) == inside)).select(batch.schema.names[:-1])

    return run


def _of(rows: DataFrame, held, inside: bool) -> DataFrame:
    """``rows`` (row, ...) on one side of a filter over hashes of row numbers; they stay where they are."""
    return rows.withColumn("mark", _mark()).mapInArrow(_through(held, inside), rows.schema)


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """row, spans: word spans of each row of ``docs`` (row long, text) covered by windows that also start elsewhere.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one row. Windows meet by their anchors, so
    each shard's FM-index holds every place its windows can equal. Passages that share their anchor but neither the words on its left nor
    those on its right share no window and are not stored. Copies of a passage are counted before they are
    moved and stored once; passages around an anchor that many different ones share are cut into single windows,
    counted again and spread, so no shard grows with the number of copies. A shard is searched by all passages it
    holds.
    """
    if window < ANCHOR:
        raise ValueError(f"window must have at least {ANCHOR} words")
    context = docs.sparkSession.sparkContext
    texts = docs.select("row", "text").where("text is not null")
    schema = "anchor long, content long, row long, start int, windows int, left long, right long"
    passage = texts.mapInArrow(_passages(window), schema)
    anchors = texts.mapInArrow(_anchors(window), "anchor long, again boolean")
    anchors = anchors.groupBy("anchor").agg(F.count("*").alias("uses"), F.max("again").alias("again"))
    anchors = anchors.where("uses > 1 or again").select("anchor", "again")
    near = written(passage.join(anchors, "anchor"), "passages")
    # a window that stands elsewhere stands there with one side of its anchor, too
    sides = near.where("not again").select(F.explode(F.array("left", "right")).alias("side")).where("side is not null")
    sides = written(sides.groupBy("side").count().where("count > 1").select("side"), "sides")
    once, on_left, on_right = near.where("not again"), F.col("left") == F.col("side"), F.col("right") == F.col("side")
    shared = [near.where("again"), once.join(sides, on_left, "left_semi"), once.join(sides, on_left, "left_anti").join(sides, on_right, "left_semi")]
    columns = ["anchor", "content", "row", "start", "windows"]
    places = written(shared[0].select(columns).unionByName(shared[1].select(columns)).unionByName(shared[2].select(columns)), "places")
    contents = places.groupBy("anchor", "content", "windows").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("one")
    )
    wide = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > SPLIT_OVER)
    contents = contents.join(wide, "anchor", "left").select("*", F.col("kinds").isNotNull().alias("split"))
    wanted = contents.groupBy(F.col("one.row").alias("row")).agg(
        F.collect_list(F.struct("anchor", "content", "windows", "n", "split", F.col("one.start").alias("start"))).alias("wanted")
    )
    wanted = written(wanted, "wanted")
    held = context.broadcast(bit_filter(wanted.select(_mark().alias("mark"))))
    asked = _of(texts, held, True).join(wanted, "row")
    units = written(asked.mapInArrow(_stored(window), _UNIT), "stored-passages")
    # a whole passage has one row already; single windows come from many passages
    alone = units.where("key = content and home = anchor").select("home", "key", "n", "words")
    cut = units.where("not (key = content and home = anchor)")
    once = alone.unionByName(cut.groupBy("home", "key").agg(F.sum("n").alias("n"), F.first("words").alias("words")))
    size = units.agg(F.sum(F.length("words")) / 8).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_WORDS))
    found = (
        once.withColumn("shard", F.pmod("home", F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_search(window), "home long, key long, spans array<struct<a:int,b:int>>")
    )
    found = written(found, "repeats")
    # from stored passages back to all their places
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    of_content = units.select("home", "key", "anchor", "content", "at").join(found, ["home", "key"])
    of_content = of_content.groupBy("anchor", "content").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    placed = places.select("anchor", "content", "row", "start").join(of_content, ["anchor", "content"])
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    return placed.groupBy("row").agg(F.flatten(F.collect_list(shifted)).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = split(part["text"])
            change = np.zeros(len(words.hash) + 1, np.int64)
            for first, own in zip(words.first.tolist(), part["spans"].to_pylist()):
                for s in own or ():
                    change[first + s["a"]] += 1
                    change[first + s["b"]] -= 1
            keep = np.cumsum(change[:-1]) == 0
            # bytes of kept words, each with the one after it, which is white space or begins the next row
            edge = words.edge
            row_end = np.repeat(edge[1:], np.diff(words.first))
            mark = np.zeros(len(words.data) + 1, np.int64)
            np.add.at(mark, words.start[keep], 1)
            np.add.at(mark, np.minimum(words.end + 1, row_end)[keep], -1)
            inside = np.cumsum(mark[:-1]) > 0
            data = np.where(SPACE[words.data], np.uint8(0x20), words.data)[inside]
            at = np.concatenate([[0], np.cumsum(inside)])[edge]
            raw = data.tobytes()
            kept = [raw[lo:hi].rstrip(b" ") for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
            total = np.diff(words.first)
            gone = total - np.diff(np.concatenate([[0], np.cumsum(keep)])[words.first])
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space), kept_sha256: one row per row of ``docs``.

    Every occurrence of a repeated window goes, the first one included. Every row is a document of its own by a row
    number that is written before the search, also where doc_id is null or repeated. Null and empty texts have no
    words and stay; other columns are not looked at.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(numbered, "rows")
    spans = written(repeated_spans(rows, window), "spans")
    # only texts that may lose words are moved
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select(_mark().alias("mark"))))
    moved = _of(rows, held, True).join(spans, "row", "left")
    still = _of(rows, held, False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return moved.unionByName(still).mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    )
