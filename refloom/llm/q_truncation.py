"""Problem 10: documents whose text was cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.llm.prefixes import extensions
from refloom.llm.truncation import judged
from refloom.sources.tables import table


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    return docs, judged(docs.select(F.col("doc_id").alias("id"), "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut inside a sentence."""
    return _judged(spark, d)[1].filter("is_cut").select(F.col("id").alias("doc_id"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut documents per source, and the length at which most of them end."""
    docs, out = _judged(spark, d)
    rows = docs.select(F.col("doc_id").alias("id"), "source", "n_chars").join(out, "id")
    lengths = rows.filter("is_cut").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    limit = lengths.groupBy(F.col("source").alias("s")).agg(F.max_by("n_chars", F.struct("n", "n_chars")).alias("usual_length"), F.max("n").alias("n_at_usual_length"))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("is_cut").alias("n_cut"))
    return per.join(limit, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n_docs", "n_cut", F.round(F.col("n_cut") / F.col("n_docs"), 6).alias("cut_share"), "usual_length", "n_at_usual_length")


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What decided that texts were cut: unit, pair, word, line or copy are the prefix join's, mark and ending are the text's own."""
    return _judged(spark, d)[1].filter("is_cut").groupBy("kind", "evidence").agg(F.count(F.lit(1)).alias("n"))


def p10_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are strict prefixes of longer texts elsewhere, with the number of documents that hold them."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''")
    facts = extensions(docs.select(F.col("text").alias("value")))
    n = docs.groupBy("text").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc_id"))
    return facts.filter("extended").join(n, F.col("value") == F.col("text")).select("first_doc_id", "n_docs", F.length("value").alias("n_chars").cast("bigint"))


QUERIES = {"p10_found": p10_found, "p10_sources": p10_sources, "p10_evidence": p10_evidence, "p10_prefixes": p10_prefixes}
ORACLES = {
    "p10_prefixes": """
with t as (select text, count(*) n_docs, min(doc_id) first_doc_id from documents where text <> '' group by 1),
o as (select *, lead(text) over (order by encode(text)) nxt from t)
select first_doc_id, n_docs, length(text)::bigint n_chars from o where starts_with(nxt, text)
"""
}
