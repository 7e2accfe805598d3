"""What is new against an earlier snapshot, or since a date."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parse_since(value: str) -> tuple[int, int | None]:
    """(year, month or None) of YYYY or YYYY-M[M]; anything else raises ValueError."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?", value.strip())
    if not m or (m[2] and not 1 <= int(m[2]) <= 12):
        raise ValueError(f"not a year or month: {value!r}")
    return int(m[1]), int(m[2]) if m[2] else None


def passes_since(year: Column, date: Column, since: str) -> Column:
    """True, false, or null where the date is unknown; the month counts only if ``since`` has one."""
    y, m = parse_since(since)
    by_year = year >= y
    if m is None:
        return by_year
    at = F.regexp_extract(date, r"^([0-9]{4}-[0-9]{2})", 1)
    return F.when(F.coalesce(at, F.lit("")) != "", at >= f"{y:04d}-{m:02d}").otherwise(by_year)


def mark_nodes(nodes: DataFrame, baseline: DataFrame | None, since: str | None) -> DataFrame:
    """Adds ``is_new`` and ``unknown_date``: absent from the baseline and recent, as far as each is asked for."""
    out = nodes
    if baseline is not None:
        out = out.join(baseline.select("id", F.lit(True).alias("_old")).distinct(), "id", "left").withColumn("_absent", F.col("_old").isNull()).drop("_old")
    recent = passes_since(F.col("year"), F.col("publication_date"), since) if since else F.lit(True)
    fresh = F.coalesce(recent, F.lit(False)) & (F.col("_absent") if baseline is not None else F.lit(True))
    asked = baseline is not None or since is not None
    out = out.withColumn("is_new", fresh if asked else F.lit(False)).withColumn("unknown_date", recent.isNull() if since else F.lit(False))
    return out.drop("_absent")


def mark_edges(edges: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds ``is_new``: no edge of this source, target and type in the baseline."""
    old = baseline.select("src", "dst", "edge_type", F.lit(True).alias("_old")).distinct()
    return edges.join(old, ["src", "dst", "edge_type"], "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")


def load_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, title, status) and edges (src, dst, edge_type) of an exported JSON snapshot.

    Without nodes, or with a node without id, it raises ValueError; edges without ends are left out.
    """
    raw = spark.read.schema("nodes array<struct<id: string, title: string, status: string>>, edges array<struct<source: string, target: string, type: string>>, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    bad = raw.filter("nodes is null or exists(nodes, n -> n.id is null)").limit(1).count()
    if bad or not raw.limit(1).count():
        raise ValueError(f"no snapshot in {path}")
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    edges = raw.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.coalesce("e.type", F.lit("primary")).alias("edge_type"))
    return nodes, edges.filter("src is not null and dst is not null")
