"""Queries of the training-data operators. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrikon.llm import bpe, leakage, lookalike, neardup, pairs, sampling, split
from metrikon.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _all_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(read(spark, d, "source_documents"), "source_documents", "doc_index", "text").unionByName(
        split.split_oversized(read(spark, d, "generated_chunks"), "generated_chunks", "doc_id", "text")
    )


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _all_pieces(spark, d).where("piece_index = 1").select("record_table", "record_id").distinct()


@query
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _all_pieces(spark, d)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(read(spark, d, "generated_examples")).select("query_id", "defect").distinct()


@query
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(read(spark, d, "generated_examples")).groupBy("defect", "evidence").agg(F.count("*").alias("pairs"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    examples = neardup.near_duplicates(read(spark, d, "generated_examples"), "generated_examples", "query_id", "query_text")
    return examples.unionByName(neardup.near_duplicates(read(spark, d, "document_examples"), "document_examples", "doc_id", "text"))


@query
def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    one = neardup.near_duplicate_classes(read(spark, d, "generated_examples"), "query_id", "query_text").select(F.lit("generated_examples").alias("record_table"), "*")
    two = neardup.near_duplicate_classes(read(spark, d, "document_examples"), "doc_id", "text").select(F.lit("document_examples").alias("record_table"), "*")
    return one.unionByName(two)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exhausted(read(spark, d, "sample_targets"), read(spark, d, "generated_examples")).select("plan_id", "category")


@query
def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(read(spark, d, "sample_targets"), read(spark, d, "generated_examples")).select("plan_id", F.col("id").alias("query_id"), "category")


@query
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return p5_sample(spark, d).groupBy("plan_id", "category").agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("ids"))


@query
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exhausted(read(spark, d, "sample_targets"), read(spark, d, "generated_examples"))


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read(spark, d, "documents"), "doc_id", "text")


@query
def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, "doc_id", "text"), "ids", "decoded")
    return docs.join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


@query
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.corpus_counts(bpe.encode(read(spark, d, "documents"), "doc_id", "text"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # Twelve words in a row score at least 24; among what the score admits, the run is the exact check.
    return p7_leaks(spark, d).where("score >= 24 AND longest_run >= 12").select("doc_id", "item_id")


@query
def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(read(spark, d, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


@query
def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize_texts(read(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "form")
