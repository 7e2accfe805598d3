"""What a viewer of the graph asks for: visible parts, sizes, search, highlighted spans, spacing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refloom.operators.search import mention_spans


def effective_status() -> Column:
    return F.when(F.col("is_new"), F.lit("new")).otherwise(F.coalesce("status", F.lit("pending")))


def visible(nodes: DataFrame, edges: DataFrame, hidden_status: list[str], hidden_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose effective status is shown, with their visible in-degree, and edges between them."""
    n = nodes.withColumn("shown_as", effective_status()).filter(~F.col("shown_as").isin(hidden_status))
    ids = n.select("id")
    e = edges.filter(~F.col("edge_type").isin(hidden_types)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    per = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("visible_in_degree"))
    return n.join(per, "id", "left").withColumn("visible_in_degree", F.coalesce("visible_in_degree", F.lit(0))), e


def node_size(mode: str, value: Column, status: Column) -> Column:
    """Radius of a node by keyword hits, pagerank, betweenness or in-degree; roots at least 30, at most 80."""
    base = {"hits": 18 + 3 * value, "pagerank": 16 + 200 * F.sqrt(value), "betweenness": 16 + 120 * F.sqrt(value), "degree": 16 + 6 * F.sqrt(value)}[mode]
    return F.least(F.lit(80.0), F.when(status == "root", F.greatest(base, F.lit(30.0))).otherwise(base).cast("double"))


def size_tier(n: Column) -> Column:
    return F.when(n <= 60, "small").when(n <= 200, "medium").when(n <= 600, "large").otherwise("huge")


def search(nodes: DataFrame, query: str, most: int = 8) -> DataFrame:
    """The ``most`` best nodes: 10 for the title, 5 for the authors; under two characters nothing."""
    if len(query) < 2:
        return nodes.limit(0).select("id", "title", F.lit(0).alias("score"))
    q = query.lower()
    score = F.when(F.lower(F.coalesce("title", F.lit(""))).contains(q), 10).otherwise(0) + F.when(F.lower(F.array_join(F.coalesce("authors", F.array()), " ")).contains(q), 5).otherwise(0)
    return nodes.select("id", "title", score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "id").limit(most)


def highlight_spans(texts: DataFrame, keywords: list[str]) -> DataFrame:
    """(id, start_pos, end_pos, kw_no): keyword spans of a text by start, overlapping ones dropped.

    Choosing spans goes from left to right, so it is done text by text in Arrow batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                last = -1
                for s, e, k in sorted((s, e, k) for k, s, e in mention_spans(text, keywords)):
                    if s >= last:
                        out.append((i, s, e, k))
                        last = e
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["id", "start_pos", "end_pos", "kw_no"])

    return texts.select("id", "text").mapInArrow(run, "id string, start_pos int, end_pos int, kw_no int")


def spread(points: DataFrame, ratio: float) -> DataFrame:
    """(id, x, y) scaled around their centroid."""
    c = points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))  # one row
    j = points.join(F.broadcast(c))
    return j.select("id", (F.col("cx") + (F.col("x") - F.col("cx")) * ratio).alias("x"), (F.col("cy") + (F.col("y") - F.col("cy")) * ratio).alias("y"))


def uncollide(points: DataFrame, spacing: float = 120.0) -> DataFrame:
    """(id, x, y) with points on one spot set side by side around it, in order of id."""
    spot = points.withColumns({"sx": F.round("x"), "sy": F.round("y")})
    n = spot.groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(W.partitionBy("sx", "sy").orderBy("id")) - 1
    j = spot.withColumn("k", k).join(n, ["sx", "sy"])
    return j.select("id", F.when(F.col("n") > 1, F.col("x") - (F.col("n") - 1) * spacing / 2 + F.col("k") * spacing).otherwise(F.col("x")).alias("x"), "y")
