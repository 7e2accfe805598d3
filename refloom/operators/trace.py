"""Tracing a keyword through the citation graph: from passages to the references beside them, and on.

The step from a paper to the papers it cites beside a keyword is the same at every level, so it is
formed once for all papers as a table of links; the levels are then a bounded traversal over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refloom.functions.ids import node_key, normalize_arxiv, normalize_doi, normalize_title
from refloom.operators.graph import bfs, components, betweenness, degrees, graph_summary, pagerank, pivots, timeline
from refloom.operators.matching import refs_in_windows, sentence_hits
from refloom.plans.lineage import cut


def identity_index(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DOI, arXiv id and title to paper id; of several papers with one of them the greatest id counts.

    ``records``: id, doi, arxiv_id, title.
    """
    one = lambda c: records.select("id", c.alias("k")).filter("k is not null and k <> ''").groupBy("k").agg(F.max("id").alias("t"))
    return one(normalize_doi(F.col("doi"))), one(normalize_arxiv(F.col("arxiv_id"))), one(normalize_title(F.col("title")))


def keyword_links(papers: DataFrame, refs: DataFrame, bib: DataFrame, records: DataFrame, keywords: list[str]) -> tuple[DataFrame, DataFrame]:
    """(src, dst, edge_id) of references beside a keyword, and (id) of the papers that mention one.

    ``papers``: paper_id, text. ``refs``: paper_id, bib_key, ref_start, ref_end. ``bib``: entry_id,
    paper_id, bib_key, doi, arxiv_id, title. Keys and ids in one notation.
    """
    hits = cut(sentence_hits(papers, "paper_id", keywords))
    beside = refs_in_windows(hits, refs, "paper_id").select("paper_id", F.explode(F.split("ref_keys", " ")).alias("bib_key")).distinct()
    by_doi, by_arxiv, by_title = (x.withColumnRenamed("k", k).withColumnRenamed("t", f"t{k}") for x, k in zip(identity_index(records), "dax", strict=True))
    b = bib.join(beside, ["paper_id", "bib_key"]).select("entry_id", "paper_id", normalize_doi(F.col("doi")).alias("d"), normalize_arxiv(F.col("arxiv_id")).alias("a"), F.nullif(normalize_title(F.col("title")), F.lit("")).alias("x"))
    b = b.join(by_doi, "d", "left").join(by_arxiv, "a", "left").join(by_title, "x", "left")
    links = b.select(F.col("paper_id").alias("src"), F.coalesce("td", "ta", "tx").alias("dst"), "entry_id").filter("dst is not null and src <> dst")
    return links.groupBy("src", "dst").agg(F.min("entry_id").alias("edge_id")), hits.select(F.col("paper_id").alias("id")).distinct()


def trace(links: DataFrame, matched: DataFrame, readable: DataFrame, root: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth, status) and edges (src, dst, depth, edge_id) of a forward trace.

    A paper at the last depth is searched, not followed. Status: root, analyzed (mentions a keyword),
    no_match, or unavailable (no text).
    """
    nodes = bfs(links, root, depth)
    nodes = nodes.join(matched.select("id", F.lit(True).alias("m")), "id", "left").join(readable.select("id", F.lit(True).alias("r")).distinct(), "id", "left")
    status = F.when(F.col("depth") == 0, "root").when(F.col("r").isNull(), "unavailable").when(F.col("m"), "analyzed").otherwise("no_match")
    nodes = cut(nodes.select("id", "depth", status.alias("status")))
    from_ = nodes.filter(F.col("depth") < depth).select(F.col("id").alias("src"), (F.col("depth") + 1).alias("depth"))
    return nodes, links.join(from_, "src").select("src", "dst", "depth", "edge_id")


def analyze(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Metrics of a graph whose nodes have id, year and status: per node, overall, per year, pivots."""
    matched = F.col("status").isin("root", "analyzed")
    between = cut(betweenness(edges, nodes))
    comps = cut(components(edges, nodes))
    top = cut(pivots(nodes, comps, between, matched))
    per = degrees(edges, nodes).join(between, "id").join(pagerank(edges, nodes).select("id", F.round("pagerank", 6).alias("pagerank")), "id")
    per = per.join(top.select("id", F.lit(True).alias("is_pivot")), "id", "left").withColumn("is_pivot", F.coalesce("is_pivot", F.lit(False)))
    return {"node_metrics": per, "global": graph_summary(edges, nodes), "timeline": timeline(nodes, matched), "pivot_papers": top}
