"""Token ids, packing and token files against the library and plain loops."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import coder, packing, token_files, tokens
from barloom.llm.tokens import default_vocabulary, encoder

TEXTS = ["", None, "one two", " lead", "trail ", "a  b\tc", "x\n\ny z", "é\xa0日本 <|endoftext|>", "w " * 9000 + "end", "one two", "it's 12 a\n b"]


def plain(text, end):
    e = encoder(default_vocabulary())
    return np.append(e.library(text) if text else np.zeros(0, "<u4"), end).astype("<u4")


def frame(spark, texts=TEXTS):
    rows = [(i * 3, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, sequence_id long")


def test_words_encode_like_whole_texts():
    e = encoder(default_vocabulary())
    assert [bytes(x) for x in e.ids(TEXTS)] == [plain(t, [])[:].tobytes() for t in TEXTS]


ODD = ["a.\nB", "end.\n\nStart, x_y", "a\n\n\nb", "it's\n's don't, can't.", "né, Ünï! ²a, 3.5, a½.", "x?!? y?!.? z_", "\u0301a, a\u0301.", "a\nb\nb,\nb, b\n\n\n", "«a», “b.”", "日本, a"]


def test_lines_and_signs_encode_like_whole_texts(monkeypatch):
    texts = ODD + [" ".join(ODD), "\n".join(ODD), "\n\n".join(ODD), ".\n".join(x.replace("\n", "") for x in ODD)]
    want = [plain(t, []).tobytes() for t in texts]
    e = tokens.Encoder(default_vocabulary())
    assert list(e.ids(texts)) == want and list(e.ids(texts[::-1])) == want[::-1]
    # a word after a line feed, or with signs after it, is not asked for again
    assert list(e.ids(["x\nb\nStart Start b"]))
    asked = []
    monkeypatch.setattr(e, "library", lambda t, own=e.library: (asked.append(t), own(t))[1])
    both = "\n".join(["Start, b", "Start. b,", "b, b. b"])
    assert list(e.ids([both])) == [plain(both, []).tobytes()] and set(asked) <= {",", "."}
    # the smallest memory gives the same
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "TOGETHER", 1)
    e = tokens.Encoder(default_vocabulary())
    assert list(e.ids(texts)) == want and list(e.ids(texts)) == want


def test_other_vocabularies_are_asked_for_whole_texts(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(default_vocabulary())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(path := str(tmp_path / "v.json"))
    e = tokens.Encoder(path)
    assert list(e.ids(ODD)) == [e.library(t).tobytes() for t in ODD]


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.zipf(1.3, n) % 50257 for n in rng.integers(1, 300, 40)]
    blocks += [np.zeros(50, int), np.arange(200) % 3, rng.integers(0, 65536, 300), np.array([65535])]
    back = coder.decode_blocks(coder.encode_blocks(blocks), [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back))
    assert len(coder.encode_blocks([np.arange(2000) % 5])[0]) < 150


@pytest.mark.parametrize("files", [1, 3])
def test_token_files_round_trip(spark, tmp_path, files):
    folder = str(tmp_path / "f")
    token_files.write_token_files(frame(spark).repartition(3), folder, files=files)
    kept = spark.read.parquet(folder)
    want, start = {}, 0
    for i, t in enumerate(TEXTS):
        ids = plain(t, [2])
        want[i * 3] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digest(kept).collect()}
    assert got == want
    ids = token_files.read_token_files(kept).where("doc_id = 24").orderBy("part").collect()
    assert [x for r in ids for x in r.ids] == plain(TEXTS[8], [2]).tolist()


def test_damaged_block_is_found(spark, tmp_path):
    token_files.write_token_files(frame(spark), str(tmp_path / "f"), files=1)
    bad = spark.read.parquet(str(tmp_path / "f")).withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="damaged"):
        token_files.token_digest(bad).collect()


def test_rows_with_one_doc_id_stay_apart(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "w " * 5000), (2, "c")], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "f"), files=1)
    got = token_files.token_digest(spark.read.parquet(str(tmp_path / "f"))).collect()
    want = sorted(zlib.crc32(plain(t, [2]).tobytes()) for t in ("a b", "w " * 5000, "c"))
    assert sorted(r.ids_crc32 for r in got) == want and sum(r.n_tokens for r in got) == sum(
        len(plain(t, [2])) for t in ("a b", "w " * 5000, "c")
    )


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [])
    token_files.write_token_files(none, str(tmp_path / "f"))
    assert token_files.token_digest(spark.read.parquet(str(tmp_path / "f"))).count() == 0
    assert packing.pack_documents(none).count() == 0


def test_pieces_can_leave_no_words_in_a_worker():
    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, fn, _: fn

    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in enumerate(TEXTS)])
    kept, left = encoder(default_vocabulary()), packing.pieces(Docs(), remember=False)
    rows = [b.to_pylist() for b in left(iter([batch, batch]))]
    assert not kept.known
    assert rows == [b.to_pylist() for b in packing.pieces(Docs())(iter([batch, batch]))] and kept.known


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_gapless_and_whole(spark, capacity):
    rows = packing.pack_documents(frame(spark).repartition(3), capacity=capacity).collect()
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in enumerate(TEXTS):
        ids, own = plain(t, [0]), sorted(docs[i * 3], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert own[-1].start + own[-1].length == len(ids)
    total = sum(len(plain(t, [0])) for t in TEXTS)
    assert len(seqs) <= -(-total // capacity) + 2


def test_merging_rounds_beat_local_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 100)
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 100, 600))]
    cuts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(12)
    local = packing.written(cuts.select(F.col("length").alias("size"), F.array(F.struct("*")).alias("items")).mapInArrow(packing._pack(100, 1), packing._BIN), "local").count()
    got = packing.pack(cuts, 100, 1)
    assert got.count() == 600
    least = -(-sum(r[3] for r in rows) // 100)
    assert least <= got.select("sequence_id").distinct().count() < min(local, least * 1.06)


def test_rounds_end_only_where_one_gains_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 1_000)
    seen, keep = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: (seen.append(out := keep(df, name)), out)[1])
    rows = [(i, 0, 0, 55, 0) for i in range(3_000)] + [(3_000, 0, 0, 40, 0)]
    cuts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").coalesce(1)
    big, small = cuts.where("length = 55").repartition(2), cuts.where("length = 40")
    assert packing.pack(big.unionByName(small), 100, 1).select("sequence_id").distinct().count() == 3_000
    open_before, after = seen[-2].where("not closed").count(), seen[-1].count()
    assert open_before == after
