"""Citation graphs as pairs of tables: views, traversal, centrality, components, pivots.

Iterative operators cut lineage through the shared checkpoint folder after every round. Nodes and
edges stay distributed; only scalars and the ids of one start node come to the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refloom.functions.ids import node_key
from refloom.plans.lineage import cut
from refloom.plans.numbering import number_rows
from refloom.plans.skew import HOT_ROWS, hot_keys, lookup_join

ALPHA, TOLERANCE, MOST_ROUNDS = 0.85, 1e-6, 100
#: Pairs of ids that betweenness holds in every worker; larger graphs are searched by joins.
MOST_BROADCAST_EDGES = 1_000_000
#: Sources whose searches run side by side in joins.
SOURCES_A_BATCH = 1_000


def node_view(nodes: DataFrame) -> DataFrame:
    """One row per paper id: the node added first."""
    w = W.partitionBy("id").orderBy(F.col("added_at").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("title").asc_nulls_last())
    return nodes.withColumn("id", node_key(F.col("paper_id"))).filter("id is not null").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def edge_view(edges: DataFrame) -> DataFrame:
    """Edges between two different ids, the first of each (source, target, type)."""
    e = edges.withColumns({"src": node_key(F.col("source_id")), "dst": node_key(F.col("target_id"))}).filter("src is not null and dst is not null and src <> dst")
    first = e.groupBy("src", "dst", "edge_type").agg(F.min_by(F.struct("edge_id", "depth", "context", "seen_at"), "edge_id").alias("x"))
    return first.select("src", "dst", "edge_type", "x.edge_id", "x.depth", "x.context", "x.seen_at")


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of a simple directed graph."""
    return edges.select("src", "dst").distinct()


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def bfs(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of every node within ``depth`` steps of the roots (id); a node keeps its first depth."""
    edges = cut(pairs(edges))
    seen = cut(roots.select("id", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        nxt = frontier.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def first_per_target(citing: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` citing rows of every cited paper, by edge id."""
    w = W.partitionBy("dst").orderBy("edge_id")
    return citing.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).withColumnRenamed("_k", "rank")


def reverse_trace(edges: DataFrame, roots: DataFrame, depth: int, limit: int, need: int) -> DataFrame:
    """(id, depth, n_contexts) of papers that cite their way to the roots in matching contexts.

    ``edges``: src, dst, edge_id, kw_no (null: the context matches no keyword). Per cited paper only
    its first ``limit`` rows are looked at; a citing paper counts if its contexts name ``need``
    different keywords.
    """
    rows = first_per_target(edges, limit).filter("kw_no is not null")
    ok = rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_contexts"), F.countDistinct("kw_no").alias("n_kw")).filter(F.col("n_kw") >= need)
    ok = cut(ok.select(F.col("src").alias("citing"), F.col("dst").alias("cited"), "n_contexts"))
    seen = cut(roots.select("id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("n_contexts")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        hits = frontier.select(F.col("id").alias("cited")).join(ok, "cited").groupBy(F.col("citing").alias("id")).agg(F.max("n_contexts").alias("n_contexts"))
        frontier = cut(hits.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "n_contexts"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) on distinct pairs."""
    ends = pairs(edges).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    n = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return nodes.select("id").distinct().join(n, "id", "left").select("id", z("in_degree"), z("out_degree"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, pagerank): power iteration; rank of nodes without out-edges goes to all alike.

    ``rounds`` fixes the number of iterations; without it iteration stops when the L1 change is below
    n times the tolerance, and ranks that do not settle become uniform.
    """
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    e = pairs(inside(edges, ids))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    # Edges with their weight stay as they are, and so do their hot sources; every round moves only ranks.
    e = cut(e.join(out, "src").select("src", "dst", (1.0 / F.col("out")).alias("w")))
    hot = [r[0] for r in hot_keys(e, "src").collect()]
    ids = cut(ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling")))
    ranks, settled = cut(ids.select("id", "dangling", F.lit(1.0 / n).alias("r"), F.lit(0.0).alias("was"))), rounds is not None
    for _ in range(rounds or MOST_ROUNDS):
        lost = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)).alias("lost")))  # one row
        got = lookup_join(e, ranks.select(F.col("id").alias("src"), "r"), "src", "inner", hot=hot).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("r")).alias("got"))
        nxt = ALPHA * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + F.lit((1 - ALPHA) / n)
        ranks = cut(ranks.join(got, "id", "left").join(lost).select("id", "dangling", nxt.alias("r"), F.col("r").alias("was")))
        if rounds is None and ranks.agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0] < n * TOLERANCE:
            settled = True
            break
    return ranks.select("id", (F.col("r") if settled else F.lit(1.0 / n)).alias("pagerank"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each weakly connected component.

    Large-star and small-star rounds: every node's neighbours are hung on its smallest neighbour, by
    minimum aggregation and a join, so a hub's neighbours never meet in one task.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    before = state(e)
    while True:
        hot = None if 2 * before["n"] > HOT_ROWS else []  # no node has more edges than there are
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both, least, "u", "inner", hot=hot).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup_join(large, least, "u", "inner", hot=hot)
        e = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = state(e)
        if before == after:
            break
        before = after
    label = e.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("id"), "c")
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def betweenness(edges: DataFrame, nodes: DataFrame, held_edges: int = MOST_BROADCAST_EDGES) -> DataFrame:
    """(id, betweenness): share of shortest directed paths through each node, over (n-1)(n-2).

    The number of edges is counted first. Up to ``held_edges`` every worker holds the adjacency and runs
    one search per source; larger graphs are searched level by level, by joins, for batches of sources.
    """
    ids = cut(nodes.select("id").distinct())
    e = cut(pairs(inside(edges, ids)))
    n = ids.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = _paths_by_worker(e, ids) if e.count() <= held_edges else _paths_by_joins(e)
    return ids.join(sums, "id", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)) * scale, 6).alias("betweenness"))


def _paths_by_joins(e: DataFrame) -> DataFrame:
    """(id, b): dependency of all sources on each node, over distinct edges (src, dst)."""
    sources = number_rows(e.select(F.col("src").alias("id")).distinct(), "id", "no")
    sources = cut(sources.select("id", F.floor((F.col("no") - 1) / SOURCES_A_BATCH).alias("batch")))
    last = sources.agg(F.max("batch")).first()[0]
    parts = []
    for batch in range(0 if last is None else last + 1):
        level = cut(sources.filter(F.col("batch") == batch).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
        levels, seen = [level], level.select("s", "v")
        while True:
            step = levels[-1].join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
            level = cut(step.join(seen, ["s", "v"], "left_anti"))
            if level.isEmpty():
                break
            levels.append(level)
            seen = seen.unionByName(level.select("s", "v"))
        below = None  # (s, v, paths, part) of the level below
        for level in reversed(levels[1:]):
            here = level.withColumn("part", F.lit(0.0))
            if below is not None:
                up = below.join(e, F.col("v") == F.col("dst")).select("s", F.col("src").alias("v"), ((1 + F.col("part")) / F.col("paths")).alias("up")).groupBy("s", "v").agg(F.sum("up").alias("up"))
                here = level.join(up, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("up", F.lit(0.0))).alias("part"))
            below = cut(here)
            parts.append(cut(below.filter("v <> s").groupBy(F.col("v").alias("id")).agg(F.sum("part").alias("b"))))
    if not parts:
        return e.select(F.col("src").alias("id"), F.lit(0.0).alias("b")).limit(0)
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("b").alias("b"))


def _paths_by_worker(e: DataFrame, ids: DataFrame) -> DataFrame:
    """The same with one search per source over an adjacency that every worker holds."""
    spark = e.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in e.collect()])  # bounded by the caller

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = {}
        for a, b in sorted(shared.value):
            out.setdefault(a, []).append(b)
        total: dict = {}
        for pdf in batches:
            for s in pdf["id"]:
                dist, paths, before, order, queue = {s: 0}, {s: 1.0}, {}, [], deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in out.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                part = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s and part[w]:
                        total[w] = total.get(w, 0.0) + part[w]
        yield pd.DataFrame({"id": list(total), "b": list(total.values())}).astype({"b": "float64"})

    kind = dict(ids.dtypes)["id"]
    sources = e.select(F.col("src").alias("id")).distinct().repartition(spark.sparkContext.defaultParallelism)
    return sources.mapInPandas(run, f"id {kind}, b double").groupBy("id").agg(F.sum("b").alias("b"))


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average degree, components; zeros for an empty graph."""
    n = nodes.agg(F.countDistinct("id").alias("n_nodes"))
    m = pairs(edges).agg(F.count(F.lit(1)).alias("n_edges"))
    c = components(edges, nodes).agg(F.countDistinct("component").alias("n_components"))
    one = F.broadcast
    most = F.when(F.col("n_nodes") > 1, F.col("n_nodes") * (F.col("n_nodes") - 1)).otherwise(1)
    j = n.join(one(m)).join(one(c))  # one row each
    return j.select("n_nodes", "n_edges", F.round(F.col("n_edges") / most, 6).alias("density"), F.round(F.coalesce(F.try_divide(2 * F.col("n_edges"), F.col("n_nodes")), F.lit(0.0)), 2).alias("avg_degree"), "n_components")


def timeline(nodes: DataFrame, matched: Column) -> DataFrame:
    """(year, total, with_keyword, keyword_density) of nodes with a year."""
    per = nodes.filter("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("with_keyword"))
    return per.withColumn("keyword_density", F.round(F.col("with_keyword") / F.col("total"), 4))


def pivots(nodes: DataFrame, comps: DataFrame, between: DataFrame, matched: Column) -> DataFrame:
    """(id) of nodes that brought a subject into a component, or stand between many.

    The earliest matched node of each component (ties: the smaller id), and matched nodes whose
    betweenness is over twice the mean.
    """
    m = nodes.filter(matched)
    first = m.filter("year is not null").join(comps, "id").groupBy("component").agg(F.min(F.struct("year", "id")).alias("x")).select("x.id")
    mean = between.agg(F.avg("betweenness").alias("mean"))  # one row
    high = between.join(F.broadcast(mean)).filter(F.col("betweenness") > 2 * F.col("mean")).select("id").join(m.select("id"), "id", "left_semi")
    return first.union(high).distinct()


def year_levels(nodes: DataFrame) -> DataFrame:
    """(id, year, level): rank of the year among the distinct years; unknown years come last."""
    years = nodes.filter("year is not null").select("year").distinct()
    ranked = years.withColumn("level", F.row_number().over(W.orderBy("year")) - 1)  # a row per year
    last = years.agg(F.count(F.lit(1)).alias("last"))
    j = nodes.select("id", "year").join(F.broadcast(ranked), "year", "left").join(F.broadcast(last))
    return j.select("id", "year", F.coalesce("level", F.col("last").cast("int")).alias("level"))


#: Vectors on either side of one task of the blocked join.
VECTOR_BLOCK = 20_000


def nearest_smaller(vectors: DataFrame, k: int, block: int = VECTOR_BLOCK) -> DataFrame:
    """(src, dst, similarity): each vector's ``k`` most similar vectors of smaller id, by inner product; ties go to the smaller id."""
    return nearest(vectors, vectors, k, block, smaller=True)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = VECTOR_BLOCK, smaller: bool = False) -> DataFrame:
    """(src, dst, similarity): for each query its ``k`` most similar other vectors, or those of smaller id only.

    All queries meet all vectors in blocks: both sides are cut into parts of about ``block`` rows, every pair of
    parts is one task, and each keeps its best ``k``, of which the best are kept. Ties go to the smaller id.
    """
    double = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    q, v = (cut(df.filter("embedding is not null").select("vec_id", double)) for df in (queries, vectors))
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (q, v))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = q.select("vec_id", "embedding", part(n_q).alias("i"), every(n_v).alias("j"))
    theirs = v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("vector"), every(n_q).alias("p"), part(n_v).alias("q"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("other")
            ids, m = b["other"].to_numpy(), np.stack(b["vector"].to_numpy())
            for i, e in zip(a["vec_id"], a["embedding"], strict=True):
                end = int(np.searchsorted(ids, i)) if smaller else len(ids)
                s, near = m[:end] @ np.asarray(e), ids[:end]
                if not smaller:
                    s, near = s[near != i], near[near != i]
                if len(s):
                    top = np.lexsort((near, -s))[:k] if len(s) <= 4 * k else _top(s, near, k)
                    out += [(i, near[t], s[t]) for t in top]
        return pd.DataFrame(out, columns=["src", "dst", "similarity"]).astype({"src": "int64", "dst": "int64", "similarity": "float64"})

    near = mine.groupBy("i", "j").cogroup(theirs.groupBy("p", "q")).applyInPandas(best, "src bigint, dst bigint, similarity double")
    if n_v == 1:
        return near
    w = W.partitionBy("src").orderBy(F.col("similarity").desc(), "dst")
    return near.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def _top(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    cut_at = np.partition(s, len(s) - k)[len(s) - k]
    near = np.nonzero(s >= cut_at)[0]
    return near[np.lexsort((ids[near], -s[near]))[:k]]
