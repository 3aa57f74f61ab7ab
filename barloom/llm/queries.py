"""Registered queries of the operators in this subpackage; SQL where it can express one on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import sql
from barloom.llm.common import table
from barloom.session import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op1_near_vectors": sql.NEAR_VECTORS,
    "op2_ngram_jaccard": sql.JACCARD,
    "op3_substring_dedup": sql.SUBSTRINGS,
    "op11_vector_codes": sql.VECTOR_CODES,
    "op12_mixing": sql.MIXING,
    "op13_periodic_runs": sql.PERIODIC_RUNS,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf, "documents"))


@query
def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.token_files import token_digest, write_token_files

    folder = scratch_folder(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), folder)
    return token_digest(spark.read.parquet(folder))


@query
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf, "documents"))


@query
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.quality import quality

    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.decontaminate import contaminations

    return contaminations(table(spark, sf, "documents"), table(spark, sf, "benchmark"), brief=True)


@query
def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.pseudonyms import pseudonymised

    return pseudonymised(table(spark, sf, "documents"), "a key of the operator's own")


@query
def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.hosts import url_verdicts

    return url_verdicts(table(spark, sf, "pages"))


@query
def op1_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.cover_tree import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))


@query
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.vector_codes import digest, vector_codes

    codes, books = vector_codes(table(spark, sf, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


@query
def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.mixing import mixed

    plan = mixed(table(spark, sf, "documents"), carry=["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.periods import looped, periodic_runs, run_digest

    return run_digest(periodic_runs(looped(table(spark, sf, "documents"))))
