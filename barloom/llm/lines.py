"""Repeated lines, exact or nearly so: one occurrence of each connected group of similar lines stays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.buckets import SMALL, bucketed, groups
from barloom.llm.common import aside, bit_filter, mixed, passes, whole, written
from barloom.llm.words import slices, split

#: Bits in which the fingerprints of two similar lines may differ, and the blocks they are cut into, as (lowest bit,
#: bits): of five blocks, two are then equal, so lines meet by pairs of blocks, whose values are many enough for large inputs.
RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bits of each byte, most significant first, in the bytes of one word: sums of up to 255 such words count eight bits at once.
_COUNTS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def normalised(line: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(line.lower().split())


def simhash(lines: list[str]) -> np.ndarray:
    """64-bit SimHash of the different words of each line; without words 0. A word that a line repeats counts once, else
    lines full of one common word would all look alike."""
    out = np.zeros(len(lines), np.uint64)
    for lo in range(0, len(lines), 256):
        words = split(pa.array(lines[lo : lo + 256], pa.string()))
        if not len(words.hash):
            continue
        # sorted: numpy's unique hashes integers, which takes several times as long here
        kinds = np.sort((words.row.astype(np.uint64) << np.uint64(52)) | (words.hash >> np.uint64(12)))
        kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])]
        row = (kinds >> np.uint64(52)).astype(np.int64)
        raw = mixed(kinds & np.uint64((1 << 52) - 1)).view(np.uint8).reshape(-1, 8)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(first, len(row)))
        votes = np.add.reduceat(_COUNTS[raw], first, axis=0).view(np.uint8).astype(np.int32)
        for k in np.flatnonzero(size > 255):
            votes[k] = np.unpackbits(raw[first[k] : first[k] + size[k]], axis=1).sum(0, dtype=np.int32)
        out[lo + row[first]] = np.packbits(2 * votes > size[:, None], axis=1).view(np.uint64).ravel()
    return out


def _lines(least: int):
    """line (hash), mark (SimHash), span (length), doc_id, whole (hash of the text), no: lines that are long enough to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, texts = [], {}
                for doc, own, text in zip(*(part[c].to_pylist() for c in ("doc_id", "whole", "text"))):
                    for no, line in enumerate((text or "").split("\n")):
                        if len(line) >= least and len(line := normalised(line)) >= least:
                            rows.append((xxhash.xxh3_64_intdigest(line), len(line), doc, own, no))
                            texts[rows[-1][0]] = line
                marks = dict(zip(texts, simhash(list(texts.values())).tolist()))
                line, span, doc, own, no = zip(*rows) if rows else ((),) * 5
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [as_long(line), as_long([marks[x] for x in line]), pa.array(span, pa.int64()), pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(no, pa.int32())],
                    names=["line", "mark", "span", "doc_id", "whole", "no"],
                )
            pa.default_memory_pool().release_unused()

    return run


def _similar_lengths(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """An edit distance is never less than the difference in length."""
    return np.abs(a - b) <= np.maximum(a, b) * (100 - percent) // 100


def _near(percent: int):
    def near(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
        close = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= RADIUS
        return close & _similar_lengths(len_a, len_b, percent)

    return near


def _blocks(lines: DataFrame) -> DataFrame:
    """(key, node, mark, span): one row for each two blocks of a fingerprint, keyed by their values."""
    part = lambda low, bits: F.expr(f"shiftrightunsigned(mark, {low}) & {(1 << bits) - 1}L")
    keys = [F.xxhash64(F.lit(k), part(*one), part(*two)) for k, (one, two) in enumerate(combinations(BLOCKS, 2))]
    return lines.select(F.explode(F.array(*keys)).alias("key"), F.col("line").alias("node"), "mark", "span")


def _within(x, y, percent: int):
    """Whether the edit distance of two strings is at most 100 - ``percent`` percent of the longer one.

    What they share at either end adds nothing to the distance and is cut off first, by halving steps. One-element
    arrays hold what the next step uses, so that nothing is computed twice.
    """
    steps = F.array(*(F.lit(1 << k) for k in range(15, -1, -1)))

    def shared(s):
        alike = lambda n, step: F.substr(s["x"], n + 1, step) == F.substr(s["y"], n + 1, step)
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(alike(n, step), n + step).otherwise(n)).alias("n")

    def without(pair):
        held = F.transform(pair, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["most"].alias("most"), shared(s)))
        rest = lambda s, end: F.reverse(F.substr(s[end], s["n"] + 1)).alias(end)
        return F.transform(held, lambda s: F.struct(rest(s, "x"), rest(s, "y"), s["most"].alias("most")))

    longer = F.greatest(F.length(x), F.length(y))
    most = F.floor(longer * F.lit(100 - percent) / F.lit(100)).cast("int")
    pair = F.array(F.struct(x.alias("x"), y.alias("y"), most.alias("most")))
    near = F.exists(without(without(pair)), lambda s: F.call_function("levenshtein", s["x"], s["y"], s["most"]) >= 0)
    return (F.abs(F.length(x) - F.length(y)) <= most) & near


def _texts(docs_wanted, lines_wanted, least: int):
    """(node, line_text) of the lines that a filter lets through, in the documents that another one does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(docs_wanted.value, batch["whole"].to_numpy())))
            for part in slices(batch):
                texts = [n for t in part["text"].to_pylist() for x in t.split("\n") if len(x) >= least and len(n := normalised(x)) >= least]
                ids = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
                own = np.flatnonzero(passes(lines_wanted.value, ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array([texts[i] for i in own.tolist()], pa.string())], names=["node", "line_text"])

    return run


def line_groups(docs: DataFrame, percent: int = 90, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """All lines of at least ``least`` normalised characters as (line, mark, span, doc_id, whole, no), and the
    (node, component) of the lines that are similar to others but not equal. ``whole`` is the hash of the text a line
    stands in: with it, texts that share an id, or have none, are told apart.

    Two lines are similar if their fingerprints differ in at most ``RADIUS`` bits and their edit distance is at most
    100 - ``percent`` percent of the longer one. Edits that change more of the fingerprint are not found.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("whole"), "text").where("text is not null")
    lines = written(texts.mapInArrow(_lines(least), "line long, mark long, span long, doc_id long, whole long, no int"), "lines")
    kinds = lines.groupBy("line").agg(F.first("mark").alias("mark"), F.first("span").alias("span"))
    found = written(bucketed(_blocks(kinds), SMALL, _near(percent)), "candidates")
    nodes = found.select(F.explode(F.array("a", "b")).alias("line"), "kind", "b")
    nodes = nodes.where("kind = 0 or line = b").select("line").distinct()
    place = lines.join(nodes, "line").groupBy("line").agg(F.min("whole").alias("whole"))
    # texts stay where they are: filters of fixed size tell which texts and lines are asked for
    held = [docs.sparkSession.sparkContext.broadcast(bit_filter(x)) for x in (place.select("whole"), nodes)]
    wording = written(texts.mapInArrow(_texts(*held, least), "node long, line_text string").distinct(), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        one = wording.select(F.col("node").alias("a"), F.col("line_text").alias("x"))
        two = wording.select(F.col("node").alias("b"), F.col("line_text").alias("y"))
        near = _within(F.col("x"), F.col("y"), percent)
        return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")

    def sketches(nodes: DataFrame) -> DataFrame:
        marks = lines.join(nodes.withColumnRenamed("node", "line"), "line").groupBy("line").agg(F.first("mark").alias("mark"), F.first("span").alias("size"))
        return marks.select(F.col("line").alias("node"), "size", F.array("mark").alias("sketch"))

    def limit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(_similar_lengths(a, b, percent), RADIUS, -1)

    return lines, groups(found, verify, sketches, limit)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            out, n, gone = [], [], []
            for text, drop in zip(part["text"].to_pylist(), part["drop"].to_pylist()):
                lines = text.split("\n") if text is not None else []
                away = set(drop or ())
                n.append(len(lines)), gone.append(len(away))
                out.append("\n".join(x for i, x in enumerate(lines) if i not in away) if away else text)
            columns = [part["doc_id"], pa.array(out, pa.string()), pa.array(n, pa.int32()), pa.array(gone, pa.int32()), part["rest"]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_lines", "n_removed", "rest"])


def _deduped(docs: DataFrame, percent: int, least: int) -> DataFrame:
    """doc_id, text, n_lines, n_removed, rest from doc_id, text, rest."""
    lines, comps = line_groups(docs, percent, least)
    at = F.struct(F.col("doc_id").isNull().alias("_"), "doc_id", "whole", "no")
    of = lines.select("line", "doc_id", "whole", "no")
    # one row per different line before groups are formed
    firsts = of.groupBy("line").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    named = firsts.join(comps, firsts["line"] == comps["node"], "left")
    named = written(named.select("line", "at", "n", F.coalesce("component", "line").alias("group")), "line-groups")
    kept = named.groupBy("group").agg(F.min("at").alias("kept"), F.sum("n").alias("n")).where("n > 1").select("group", "kept")
    away = named.join(kept, "group").select("line", "kept")
    drop = of.join(away, "line").where(~at.eqNullSafe(F.col("kept")))
    drop = drop.groupBy(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole")).agg(F.collect_set("no").alias("drop"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_whole")) & F.col("text").isNotNull()
    rows = docs.join(drop, same, "left").select("doc_id", "text", "drop", "rest")
    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(_without, f"doc_id long, text string, n_lines int, n_removed int, rest {kind}")


def dedup_lines(docs: DataFrame, percent: int = 90, least: int = 20) -> DataFrame:
    """doc_id, text, n_lines, n_removed: every document with only the first occurrence of similar lines.

    Lines are the parts between line feeds, compared in lower case with white space evened out. Of each connected
    group of equal or similar lines (see ``line_groups``) the occurrence with the smallest (doc_id, line number)
    stays, null ids last; texts that share an id, or have none, are ordered by a hash of the text. Shorter lines stay everywhere. A document that loses all its lines stays with an empty text; a null text
    stays null. Rows that repeat a doc_id and text are one document and keep the same lines; rows that repeat only the
    doc_id are documents of their own. Other columns are not
    looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("rest"))
    return _deduped(rows, percent, least).drop("rest")


def without_repeated_lines(docs: DataFrame, percent: int = 90, least: int = 20) -> DataFrame:
    """``docs``, all rows and columns, with the texts of ``dedup_lines``. doc_id is a long."""
    return whole(_deduped(aside(docs), percent, least), docs.columns)
