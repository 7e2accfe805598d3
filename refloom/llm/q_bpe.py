"""Problem 8: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.llm.bpe import encoded, vocabulary
from refloom.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return encoded(docs, vocabulary(spark)).select(F.col("id").alias("doc_id"), "ids")


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and characters per token by source."""
    docs = table(spark, d, "documents")
    n = encoded(docs.select(F.col("doc_id").alias("id"), "text"), vocabulary(spark), counts_only=True)
    j = docs.select(F.col("doc_id").alias("id"), "source", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(n, "id")
    agg = j.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("chars").cast("bigint").alias("n_chars"))
    return agg.withColumn("chars_per_token", F.round(F.try_divide("n_chars", "n_tokens"), 4))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}
ORACLES: dict[str, str] = {}
