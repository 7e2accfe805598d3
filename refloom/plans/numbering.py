"""Numbering rows over a whole table without one task holding it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refloom.plans.lineage import cut


def number_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: 1.. in order of ``key`` (unique).

    Rows are put in ranges of the key, sampled so that they are alike in size whatever the keys begin
    with; the ranges' row counts give each its offset, and rows count up within.
    """
    ordered = cut(df.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")))
    offsets, at = {}, 0
    for r in sorted(ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_p"]):  # a row per task
        offsets[r["_p"]], at = at, at + r["n"]
    if not offsets:
        return ordered.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    start = F.broadcast(df.sparkSession.createDataFrame(list(offsets.items()), "_p int, _o bigint"))
    return ordered.join(start, "_p").select(*df.columns, (F.col("_i") + F.col("_o") + 1).alias(name))
