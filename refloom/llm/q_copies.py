"""Problem 1: bibliography entries that differ in formatting alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.llm.canonical import canonical_bytes
from refloom.llm.radix import copies
from refloom.sources.tables import table


def canonical_keys(entries: DataFrame) -> DataFrame:
    """(entry_id, raw, title, authors) -> (id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(i).to_pylist() for i in (1, 2, 3))
            keys = [canonical_bytes(*row) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["id", "key"])

    return entries.select("entry_id", "raw", "title", "authors").mapInArrow(run, "id bigint, key binary")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per further copy of an entry."""
    out = copies(canonical_keys(table(spark, d, "bib_entries")))
    return out.filter("id <> first_id").select(F.col("first_id").alias("entry_id"), F.col("id").alias("copy_entry_id"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per group of copies with their number."""
    entries = table(spark, d, "bib_entries")
    out = copies(canonical_keys(entries)).filter("id = first_id").select(F.col("id").alias("entry_id"), "n_copies")
    return out.join(entries.select("entry_id", "title", "raw", "pub_year"), "entry_id")


QUERIES = {"p1_found": p1_found, "p1_records": p1_records}
ORACLES: dict[str, str] = {}
