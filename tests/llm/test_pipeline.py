"""The pipeline's stages, one after the other, against plain Python on a small table."""

import test_decontaminate
import test_jaccard
import test_lines
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import quality

SMALL = "/root/testdata/sf0.001"


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("drop", F.lit("x")).withColumn("node", F.lit(1))
    outs, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, SMALL), "stage")
        outs[name] = now
        if name != "packing":
            assert now.columns == docs.columns and now.schema.simpleString() == docs.schema.simpleString()
    texts = {k: {r.doc_id: r.text for r in v.collect()} for k, v in outs.items() if k != "packing"}
    scores = quality.quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(texts["quality"]) == {r.doc_id for r in scores.collect() if r.predicted} != set()
    want = test_lines.brute(texts["quality"])
    assert texts["lines"] == {d: w[0] for d, w in want.items()} != texts["quality"]
    assert all(r.n_chars == len(r.text) for r in outs["lines"].collect())
    groups = test_jaccard.brute(texts["lines"])
    assert texts["near_copies"] == {d: t for d, t in texts["lines"].items() if groups[d][1] == d}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    leaked = {d for d, _ in test_decontaminate.brute(texts["near_copies"], items)}
    assert set(texts["leaks"]) == set(texts["near_copies"]) - leaked
    assert {r.doc_id for r in outs["packing"].select("doc_id").collect()} == set(texts["leaks"])


def test_odd_rows(spark):
    say = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, say), (4, say + " end"), (5, say), (5, say), (None, "no id"), (6, "z " * 9000)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "stage")
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 4, 5, 6, None}
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.written(stage(spark, none, SMALL), "stage")
    assert none.count() == 0


def test_rows_that_share_an_id(spark):
    """One row of a group of near copies stays, whatever ids the rows have; unique texts stay."""
    say = [f"w{i}" for i in range(60)]
    texts = {k: " ".join(v) for k, v in {"a": say, "b": say[:-1] + ["end"], "u": [f"u{i}" for i in range(60)], "v": [f"v{i}" for i in range(40)]}.items()}
    rows = [(1, "a"), (2, "a"), (2, "u"), (1, "b"), (1, "v"), (None, "b"), (None, "v"), (None, None), (0, None)]
    docs = spark.createDataFrame([(d, texts.get(t), "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.written(docs.repartition(2), "docs")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()]
    assert sorted(map(str, kept)) in [
        sorted(map(str, [(1, texts[first]), (2, texts["u"]), (1, texts["v"]), (None, None), (0, None)])) for first in "ab"
    ]
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.lines(spark, docs, SMALL).collect()]
    assert len(mixed) == len(rows) and (2, texts["u"]) in mixed
    assert sum(t == texts["v"] for _, t in mixed) == 1 and sum(t in (texts["a"], texts["b"]) for _, t in mixed) >= 1
