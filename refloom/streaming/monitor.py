"""Arriving citation rows as a stream: counts in windows, and edges that a snapshot lacks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.functions.ids import node_key
from refloom.plans.lineage import ensure_checkpoint_dir


def edge_stream(spark: SparkSession, path: str, schema_from: str, files_per_batch: int = 4) -> DataFrame:
    """Stream of parquet files under ``path`` with the schema of ``schema_from``."""
    return spark.readStream.schema(spark.read.parquet(schema_from).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _state_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def window_counts(stream: DataFrame, width: str = "1 day", late: str = "400 days") -> DataFrame:
    """Rows and sources per window of seen_at and edge type; windows older than the watermark leave the state."""
    # Watermarks need zoned times; the session's zone is put on and, in what is read off, taken away.
    timed = stream.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", late)
    return timed.groupBy(F.window("seen_at", width), "edge_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("source_id").alias("n_sources"))


def drain(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregate over all files there are, in update mode, and gives the last row of each ``keys``.

    Every batch writes only the rows that it changed, into a folder of its own in the shared folder: nothing is
    held on the driver, and windows behind the watermark leave the state.
    """
    out, schema = f"{_state_folder(stream.sparkSession)}/rows", stream.schema
    rows = _written(stream, out, "update", lambda batch: batch)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")
    return last.select(*schema.names)


def _written(stream: DataFrame, out: str, mode: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over all files there are; batches go to folders of their own, so one that is run again replaces its rows."""

    def write(batch: DataFrame, no: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch={no}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(f"{out}/batch=*")


def new_edges(stream: DataFrame, baseline: DataFrame) -> DataFrame:
    """Edges of the stream that the baseline (src, dst, edge_type) lacks; each batch is written as it comes."""

    def fresh(batch: DataFrame) -> DataFrame:
        e = batch.select("edge_id", node_key(F.col("source_id")).alias("src"), node_key(F.col("target_id")).alias("dst"), "edge_type").filter("src is not null and dst is not null and src <> dst")
        return e.join(baseline, ["src", "dst", "edge_type"], "left_anti")

    return _written(stream, f"{_state_folder(stream.sparkSession)}/rows", "append", fresh).select("edge_id", "src", "dst", "edge_type")
