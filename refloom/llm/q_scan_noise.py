"""Problem 4: scanned papers as continuous paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.llm.scan_noise import noise_spots, repaired
from refloom.sources.tables import table


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", "text", "title", "authors", "text_origin")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per noise spot of scanned papers."""
    return noise_spots(_papers(spark, d)).select("paper_id", "line_no", "noise_kind", "fixed_word")


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of scanned papers."""
    out = repaired(_papers(spark, d)).select("paper_id", F.posexplode(F.split("text", "\n\n")).alias("par_no", "paragraph"))
    return out.filter("paragraph <> ''")


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
ORACLES: dict[str, str] = {}
