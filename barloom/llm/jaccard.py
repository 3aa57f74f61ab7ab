"""Documents linked by the Jaccard similarity of their word shingles: a parity-sketch join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.buckets import alike, bucketed, groups, runs, sketches_of
from barloom.llm.common import bit_filter, mixed, passes, written
from barloom.llm.words import shingle_sets, signed, slices, split

#: Documents whose shingles tell which are common, and the most common ones that are remembered. Both only order words
#: of a sketch; results do not depend on them.
SAMPLED, REMEMBERED = 4_000, 100_000
#: Bits of the parity sketches that candidates must pass before their shingles are moved.
SKETCH_BITS = 2048
#: Partners that one task verifies against a document before others share the work.
TOGETHER = 500


def _set_id(shingles: np.ndarray) -> np.uint64:
    """One hash for a set of shingles."""
    return mixed(np.array([mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0]


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(split(part["text"], lower=True), k))
                ids = np.array([_set_id(s) for s in sets], np.uint64)
                size = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["mark"], size, signed(ids)], names=["doc_id", "mark", "n", "node"])

    return run


def _shingles(k: int, wanted, bits: int):
    """(node, n, shingles, sketch) of the texts that a filter of their marks lets through. Each shingle flips one of
    ``bits`` bits of the parity sketch, so two sketches differ in no more bits than the sets in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch["mark"].to_numpy())))
            for part in slices(batch):
                nodes, size, raw, flips = [], [], [], []
                for s in shingle_sets(split(part["text"], lower=True), k):
                    odd = np.bincount((s >> np.uint64(13)) % np.uint64(bits), minlength=bits) & 1
                    nodes.append(_set_id(s)), size.append(len(s)), raw.append(s.tobytes())
                    flips.append(np.packbits(odd.astype(bool)).view(np.int64))
                columns = [signed(np.array(nodes, np.uint64)), pa.array(size, pa.int64()), pa.array(raw, pa.binary()), pa.array(flips, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "shingles", "sketch"])

    return run


class Bands:
    """Size bands and the number of sketch words that make the pigeonhole hold in them.

    Linked sets of sizes a >= b have b >= t a and differ in at most (a + b) (1 - t) / (1 + t) shingles, t being the
    threshold. A sketch has one word per block of hash values: the XOR of the shingles in the block. A differing
    shingle changes one word, so sketches differ in at most as many words.
    """

    def __init__(self, percent: int) -> None:
        self.t = percent

    def apart(self, a, b):
        """The most shingles in which linked sets of these sizes differ."""
        return (a + b) * (100 - self.t) // (100 + self.t)

    def of(self, size: int) -> list[int]:
        """The band of a set and, if smaller partners can lie there, the band below."""
        own = size.bit_length() - 1
        smallest = -(-self.t * size // 100)
        return list(range(max(smallest, 1).bit_length() - 1, own + 1))

    def words(self, band: int) -> int:
        """Words of a sketch in a band: half as many again as may differ in its largest pair."""
        top = (2 << band) - 1
        return self.apart(100 * top // self.t, top) * 3 // 2 + 1

    def kept(self, size: int, band: int) -> int:
        """Words that a set contributes: one more than may differ from any partner in the band."""
        top = (2 << band) - 1
        largest = 100 * size // self.t if size <= top else top
        return self.apart(size, largest) + 1


def _sketch_rows(k: int, percent: int, common):
    """(key, node) for the sketch words of each set that are needed to meet every partner.

    Of two sets of n words that agree in at least n - d, the first d + 1 in any order of word values have one in common. Words
    with many uncommon shingles come first, so passages that many documents share do not fill the buckets. A task
    sends a set once however many copies it sees.
    """
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, sent = common.value, set()
        for batch in batches:
            for part in slices(batch):
                keys, nodes = [], []
                for s in shingle_sets(split(part["text"], lower=True), k):
                    node = int(_set_id(s))
                    if not len(s) or node in sent:
                        continue
                    sent.add(node)
                    rare = ~np.isin(s, usual) if len(usual) else np.ones(len(s), bool)
                    for band in bands.of(len(s)):
                        n = bands.words(band)
                        block = (s >> np.uint64(20)) % np.uint64(n)
                        by = np.argsort(block)
                        sorted_block = block[by]
                        first = np.flatnonzero(np.append(True, sorted_block[1:] != sorted_block[:-1]))
                        value = np.bitwise_xor.reduceat(mixed(s[by]), first)
                        many = np.add.reduceat(rare[by].astype(np.int64), first)
                        all_ = np.diff(np.append(first, len(s)))
                        word = mixed(value + sorted_block[first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))
                        need = bands.kept(len(s), band)
                        if need > len(first):  # words without a shingle are all alike; few are ever needed
                            empty = np.arange(n, dtype=np.uint64)[~np.isin(np.arange(n, dtype=np.uint64), sorted_block)]
                            blank = mixed(empty * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))
                            word = np.append(word, np.sort(blank)[: need - len(first)])
                            many, all_ = (np.append(x, np.zeros(len(word) - len(x), np.int64)) for x in (many, all_))
                        take = np.lexsort((word, -all_, -many))[:need]
                        keys.append(word[take])
                        nodes.append(np.full(len(take), node, np.uint64))
                if keys:
                    yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), signed(np.concatenate(nodes))], names=["key", "node"])

    return run


def _common_shingles(texts: DataFrame, k: int, total: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for s in shingle_sets(split(part["text"], lower=True), k):
                    yield pa.RecordBatch.from_arrays([signed(s)], names=["shingle"])

    share = max(1, total // SAMPLED)
    few = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    counted = few.mapInArrow(run, "shingle long").groupBy("shingle").count()
    top = counted.where(f"count >= {max(4, SAMPLED // 250)}").orderBy(F.desc("count"), "shingle").limit(REMEMBERED)
    return np.sort(np.array([r.shingle for r in top.collect()], np.int64).view(np.uint64))


def _both(lead: np.ndarray, own: np.ndarray) -> int:
    """How many shingles two sets share."""
    at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
    return int((lead[at] == own).sum())


def _joined(percent: int):
    """Walk the cells of families (key, node, comp, size, block, alone, sketch, shingles): links that join components
    where any do. A pair is compared by its shingles only if its sketches allow a link and no link of the cell connects
    it already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches):
            node, size, block, alone = (cell[c].to_numpy() for c in ("node", "size", "block", "alone"))
            comp = cell["comp"].to_numpy().copy()
            sets = [np.frombuffer(s, np.uint64) for s in cell["shingles"].to_pylist()]
            a, b = [], []
            for i, j in alike(comp, size, sketches_of(cell), Bands(percent).apart):
                own = (block[i] != block[j]) | (alone[i] == 1)
                for p, q in zip(i[own].tolist(), j[own].tolist()):
                    if comp[p] == comp[q]:
                        continue
                    both = _both(sets[p], sets[q])
                    if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                        comp[comp == comp[q]] = comp[p]
                        a.append(min(node[p], node[q])), b.append(max(node[p], node[q]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _check(percent: int):
    """Walk (lead, salt, kind, node, shingles): after a lead's own row come the sets to compare it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            a, b = [], []
            for row in batch.select(["lead", "kind", "node", "shingles"]).to_pylist():
                own = np.frombuffer(row["shingles"], np.uint64)
                if row["kind"] == 0:
                    lead = own
                    continue
                both = _both(lead, own)
                if 100 * both >= percent * (len(lead) + len(own) - both):
                    a.append(row["lead"]), b.append(row["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by sizes and parity sketches, then by the shingles themselves."""
    for end in ("a", "b"):
        pairs = pairs.join(shingles.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    pairs = written(pairs.where(apart <= most).select("a", "b"), "pairs")
    leads = pairs.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    heads = leads.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("lead").alias("node"))
    rest = pairs.join(leads, pairs["a"] == leads["lead"]).select("lead", F.pmod("b", "parts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("node"))
    rows = heads.unionByName(rest).join(shingles.select("node", "shingles"), "node")
    dealt = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind")
    return dealt.mapInArrow(_check(percent), "a long, b long")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: groups of documents linked by 100 * intersection >= percent * union.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a document's set is that of its ``k``-word
    shingles, or its whole sequence if it has fewer words. Documents without words, null or empty, have no set and
    link with nothing. Equal sets are one node. component_id is the smallest doc_id a document reaches over links,
    null where all of them are null. Every row is judged by its own text, also where doc_id is null or repeated; inside,
    a text stands for itself by its hash. Other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sets = written(texts.mapInArrow(_sets(k), "doc_id long, mark long, n long, node long"), "sets")
    full = texts.where("text is not null")
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(full, k, sets.count()))
    rows = full.mapInArrow(_sketch_rows(k, percent, common), "key long, node long")
    found = written(bucketed(rows), "candidates")
    asked = found.where("kind = 0").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"))
    # texts stay where they are: a filter of fixed size tells which of them stand for a candidate
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(one.join(asked, "node").select("mark")))
    kept = full.mapInArrow(_shingles(k, wanted, SKETCH_BITS), "node long, n long, shingles binary, sketch array<long>")
    shingles = written(kept.dropDuplicates(["node"]), "shingles")
    bands = Bands(percent)

    def joined(cells: DataFrame) -> DataFrame:
        rows = cells.join(shingles.select("node", "sketch", "shingles"), "node")
        rows = rows.select("key", "node", "comp", "size", "block", "alone", "sketch", "shingles")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_joined(percent), "a long, b long").distinct()

    comps = groups(
        found,
        lambda pairs: _verified(pairs, shingles, percent),
        lambda nodes: shingles.select("node", F.col("n").alias("size"), "sketch").join(nodes, "node"),
        bands.apart,
        joined,
    )
    # a set's group is named by the smallest document of any set in it
    named = one.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    out = sets.join(named, "node", "left")
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
