"""Problem 5: which resolved paper a bibliography entry cites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.llm import cascade as C
from refloom.plans.lineage import cut
from refloom.sources.tables import table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    entries = table(spark, d, "bib_entries").select(F.col("entry_id").alias("id"), "title", "authors", F.col("pub_year").alias("year"), "raw")
    papers = table(spark, d, "resolved_refs").select(F.col("paper_id").alias("id"), "title", "authors", F.col("pub_year").alias("year"), F.lit(None).cast("string").alias("raw"))
    # Deliveries repeat: the distinct descriptions of a paper carry all its keys.
    return entries, papers.filter("id is not null and title is not null").distinct()


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return C.cascade(*_sides(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Matching pairs of entry and paper."""
    return _matches(spark, d).select(F.col("id").alias("entry_id"), "paper_id")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Matching pairs with rule and confidence."""
    entries, papers = _sides(spark, d)
    papers = C.read_forms(papers, "string")
    found = C.match_forms(C.read_forms(entries, "bigint"), papers)
    conf = cut(C.rule_precision(papers))
    out = found.join(F.broadcast(conf), "rule", "left")  # a row per rule: sixteen at most
    return out.select(F.col("id").alias("entry_id"), "paper_id", "rule", F.round(F.coalesce("confidence", F.lit(0.5)), 6).alias("confidence"))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of every rule with the number of labelled matches it rests on."""
    return C.rule_precision(C.read_forms(_sides(spark, d)[1], "string")).select("rule", "n_labelled", F.round("confidence", 6).alias("confidence"))


QUERIES = {"p5_found": p5_found, "p5_confidence": p5_confidence, "p5_rules": p5_rules}
ORACLES: dict[str, str] = {}
