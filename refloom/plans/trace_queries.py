"""Queries that compose operators: keyword traces, and streams over the citation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refloom.functions.ids import node_key
from refloom.operators import trace as TR
from refloom.operators.graph import edge_view
from refloom.plans.graph_queries import NV
from refloom.plans.meta_queries import _A, _D, _T
from refloom.plans.text_queries import KEYWORDS, _BAR, _SENT
from refloom.sources.tables import table
from refloom.streaming import monitor

#: Words that papers use often enough for a trace to go on.
TRACE_WORDS = ["recurrent", "learning", "baseline"]
DEPTH = 3


def links_of(spark: SparkSession, d: str, words: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links beside the words, papers that mention one, and papers with a text, of the tables in a folder."""
    key = F.regexp_replace(F.lower(F.trim("bib_key")), "^#", "").alias("bib_key")
    pid = node_key(F.col("paper_id")).alias("paper_id")
    papers = table(spark, d, "papers").select(pid, "text", "title", "doi", "arxiv_id")
    refs = table(spark, d, "inline_refs").filter("bib_key is not null").select(pid, key, F.col("start_pos").alias("ref_start"), F.col("end_pos").alias("ref_end"))
    bib = table(spark, d, "bib_entries").select("entry_id", pid, key, "doi", "arxiv_id", "title")
    records = papers.select(F.col("paper_id").alias("id"), "doi", "arxiv_id", "title").unionByName(table(spark, d, "paper_nodes").select(node_key(F.col("paper_id")).alias("id"), "doi", "arxiv_id", "title"))
    links, matched = TR.keyword_links(papers.select("paper_id", "text"), refs, bib, records, words)
    return links, matched, papers.select(F.col("paper_id").alias("id"))


def keyword_links(spark: SparkSession, d: str) -> DataFrame:
    """Papers cited beside a keyword."""
    return links_of(spark, d, TRACE_WORDS)[0]


def trace_forward(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the trace from the paper that cites most beside a keyword."""
    links, matched, readable = links_of(spark, d, TRACE_WORDS)
    root = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "id").limit(1).select("id")
    return TR.trace(links, matched, readable, root, DEPTH)[0]


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Citations per day and type, counted from a stream of files."""
    s = monitor.edge_stream(spark, f"{d}/citation_edges*", f"{d}/citation_edges.parquet")
    return monitor.drain(monitor.window_counts(s), ["window", "edge_type"]).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "edge_type", "n")


def stream_new_edges(spark: SparkSession, d: str) -> DataFrame:
    """Streamed edges that the snapshot of an earlier day lacks."""
    s = monitor.edge_stream(spark, f"{d}/citation_edges*", f"{d}/citation_edges.parquet")
    old = edge_view(table(spark, d, "citation_edges").filter(F.col("seen_at") < F.lit("2025-01-01").cast("timestamp_ntz"))).select("src", "dst", "edge_type")
    return monitor.new_edges(s, old)


QUERIES = {f.__name__: f for f in (keyword_links, trace_forward, stream_windows, stream_new_edges)}

def _pattern(word: str) -> str:
    """A word's pattern in the checking engine's notation: of five letters and more, two go and any ending may follow."""
    return r"(?i)(?:^|[^\pL\pM\pN_])" + (word[:-2] + r"[\pL\pM\pN_]*" if len(word) > 4 else word)


_HITS = _SENT
for _old, _bar, _new in zip(KEYWORDS, _BAR, TRACE_WORDS, strict=True):
    _HITS = _HITS.replace(f"'{_old}', '{_bar}'", f"'{_new}', '{_pattern(_new)}'")
_KEY = "regexp_replace(lower(trim({0}.bib_key)), '^#', '')"
_REL = f"""{_HITS}, {NV},
  beside as (select distinct h.paper_id, {_KEY.format('r')} k from hits h join inline_refs r on r.paper_id = h.paper_id and r.bib_key is not null and r.start_pos >= h.start_pos and r.end_pos <= h.start_pos + n + m),
  rec as (select lower(trim(paper_id)) id, doi, arxiv_id, title from papers union all select lower(trim(paper_id)), doi, arxiv_id, title from paper_nodes),
  dn as (select {_D('doi')} k, max(id) t from rec where {_D('doi')} is not null group by 1), an as (select {_A('arxiv_id')} k, max(id) t from rec where {_A('arxiv_id')} is not null group by 1), tn as (select {_T('title')} k, max(id) t from rec where {_T('title')} <> '' group by 1),
  lk as (select lower(trim(b.paper_id)) src, coalesce(dn.t, an.t, tn.t) dst, min(entry_id) edge_id from bib_entries b join beside on beside.paper_id = b.paper_id and beside.k = {_KEY.format('b')}
    left join dn on dn.k = {_D('b.doi')} left join an on an.k = {_A('b.arxiv_id')} left join tn on tn.k = nullif({_T('b.title')}, '') where coalesce(dn.t, an.t, tn.t) <> lower(trim(b.paper_id)) group by all)
"""
ORACLES = {
    "keyword_links": _REL + "select src, dst, edge_id from lk",
    "trace_forward": _REL.replace("with kw", "with recursive kw")
    + f""", lm as materialized (select * from lk), root as (select src id from lm group by 1 order by count(*) desc, 1 limit 1), r(id, depth) as (select id, 0 from root union select dst, depth + 1 from r join lm on src = id where depth < {DEPTH}),
        f as (select id, min(depth)::int depth from r group by 1)
        select id, depth, case when depth = 0 then 'root' when id not in (select lower(trim(paper_id)) from papers) then 'unavailable' when id in (select lower(trim(paper_id)) from hits) then 'analyzed' else 'no_match' end status from f""",
    "stream_windows": "select strftime(seen_at, '%Y-%m-%d') as day, edge_type, count(*) n from citation_edges where seen_at is not null group by all",
    "stream_new_edges": """with e as (select edge_id, lower(trim(source_id)) src, lower(trim(target_id)) dst, edge_type, seen_at from citation_edges where target_id is not null and source_id is not null and lower(trim(source_id)) <> lower(trim(target_id)))
        select edge_id, src, dst, edge_type from e where (src, dst, edge_type) not in (select (src, dst, edge_type) from e where seen_at < timestamp '2025-01-01')""",
}
