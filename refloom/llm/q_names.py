"""Problem 6: spellings of persons and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.llm.name_links import name_classes, name_pairs
from refloom.sources.tables import table


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_entries").select(F.explode("authors").alias("name")).unionByName(table(spark, d, "paper_nodes").select(F.explode("authors").alias("name")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person or group."""
    return name_pairs(name_classes(_names(spark, d)))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its class, how often it occurs and how many spellings the class has."""
    classes = name_classes(_names(spark, d))
    size = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n_spellings"), F.max_by("name", F.struct("n", "name")).alias("usual_spelling"))
    return classes.join(size, "class").select("name", "n", "usual_spelling", "n_spellings")


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes}
ORACLES: dict[str, str] = {}
