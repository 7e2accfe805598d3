"""Problem 3: sentence units of papers and passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.llm.sentences import sentence_spans
from refloom.sources.tables import table


def sentences(df: DataFrame) -> DataFrame:
    """(src_table, row_key, text) -> (src_table, row_key, unit_no, start_pos, end_pos, unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for src, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for n, (s, e) in enumerate(sentence_spans(text)):
                    for col, v in zip(cols, (src, key, n, s, e, text[s:e]), strict=True):
                        col.append(v)
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["src_table", "row_key", "unit_no", "start_pos", "end_pos", "unit"])

    return df.select("src_table", "row_key", "text").mapInArrow(run, "src_table string, row_key string, unit_no int, start_pos int, end_pos int, unit string")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").filter("text_origin = 'tei'").select(F.lit("papers").alias("src_table"), F.col("paper_id").alias("row_key"), "text")
    hits = table(spark, d, "keyword_hits").select(F.lit("keyword_hits").alias("src_table"), F.col("hit_id").cast("string").alias("row_key"), F.col("passage").alias("text"))
    return papers.unionByName(hits)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per sentence unit."""
    return sentences(_texts(spark, d)).select("src_table", "row_key", "start_pos", "end_pos")


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """Units of every document: their number and mean length by language."""
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("src_table"), F.col("doc_id").cast("string").alias("row_key"), "text")
    out = sentences(docs).groupBy(F.col("src_table").alias("lang"))
    return out.agg(F.countDistinct("row_key").alias("n_docs"), F.count(F.lit(1)).alias("n_units"), F.round(F.avg(F.col("end_pos") - F.col("start_pos")), 3).alias("mean_chars"))


QUERIES = {"p3_found": p3_found, "p3_documents": p3_documents}
ORACLES: dict[str, str] = {}
