"""A corpus pipeline of five stages: quality, repeated lines, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of their input. Stages handle null ids and texts, empty tables and
further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table, written
from barloom.llm.decontaminate import decontaminated
from barloom.llm.jaccard import jaccard_groups
from barloom.llm.lines import without_repeated_lines
from barloom.llm.packing import pack_documents
from barloom.llm.quality import good_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    return good_rows(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with one occurrence of each group of similar lines left; n_chars, if there, is counted anew."""
    out = without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null ids last. Documents without words are no
    copies. Rows are told apart by a number that is written first, so rows that share an id are judged one by one.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest"))
    rows = written(numbered, "pipeline-rows")
    texts = rows.select(F.col("row").alias("doc_id"), F.col("rest.text").alias("text"))
    groups = jaccard_groups(texts).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    place = rows.select("row", F.struct(F.col("rest.doc_id").isNull(), "rest.doc_id", "row").alias("place"))
    placed = written(groups.join(place, "row"), "pipeline-groups")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = placed.join(first, "component_id").where("row <> first.row").select("row")
    return rows.join(gone, "row", "left_anti").select("rest.*")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), brief=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequences and places. Workers also serve other stages, so they keep no words."""
    return pack_documents(docs, remember=False)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("packing", packing)]

#: Fitted scores, edit distances and packing are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
