"""Problem 7: references to records that do not exist, over the citation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refloom.operators.integrity import State, advance, clean_key, parent_events, snapshot, standing_events
from refloom.sources.tables import table


def _pair(paper: Column, key: Column) -> Column:
    return F.concat(F.lit("b\x1f"), clean_key(paper), F.lit("\x1f"), clean_key(key, strip_hash=True))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = F.col
    inline, edges = table(spark, d, "inline_refs"), table(spark, d, "citation_edges")
    bib, nodes, base = table(spark, d, "bib_entries"), table(spark, d, "paper_nodes"), table(spark, d, "baseline_nodes")
    node = lambda x: F.concat(F.lit("n\x1f"), clean_key(x))
    ends = F.array(
        F.struct(F.lit("citation_edges.source_id").alias("kind"), node(c("source_id")).alias("key")),
        F.struct(F.lit("citation_edges.target_id").alias("kind"), node(c("target_id")).alias("key")),
    )
    refs = inline.select(F.lit("inline_refs.bib_key").alias("kind"), c("ref_id").alias("row_id"), _pair(c("paper_id"), c("bib_key")).alias("key"), "seen_at").unionByName(
        edges.select(c("edge_id").alias("row_id"), "seen_at", F.explode(ends).alias("e")).select("e.kind", "row_id", "e.key", "seen_at")
    )
    events = parent_events(bib, _pair(c("paper_id"), c("bib_key")), c("added_at"), c("removed_at")).unionByName(parent_events(nodes, node(c("paper_id")), c("added_at"), c("removed_at")))
    return refs, events, standing_events(base.select(node(c("paper_id")).alias("key")).distinct())


def _split(df: DataFrame) -> list[Column]:
    return [F.substring_index("kind", ".", 1).alias("ref_table"), F.substring_index("kind", ".", -1).alias("ref_field")]


def _maintained(spark: SparkSession, d: str) -> tuple[State, DataFrame]:
    """The state after two steps: all that happened before the last half year of references, then that half year."""
    refs, events, standing = _inputs(spark, d)
    split = refs.agg((F.date_trunc("month", F.max("seen_at")).cast("timestamp_ntz") - F.expr("interval 6 months")).alias("t")).first()["t"]
    old_refs, old_events = (F.coalesce(F.col(c) < F.lit(split).cast("timestamp_ntz"), F.lit(True)) for c in ("seen_at", "ts"))
    state, _ = advance(State.empty(spark), refs.filter(old_refs), events.filter(old_events).unionByName(standing))
    return advance(state, refs.filter(~old_refs), events.filter(~old_events))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per orphan reference."""
    df = _maintained(spark, d)[0].orphans()
    return df.select(*_split(df), "row_id")


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the last step of the maintained state changed: new orphans, resolved and reopened ones, per field."""
    df = _maintained(spark, d)[1]
    return df.groupBy("kind", "change").agg(F.count(F.lit(1)).alias("n")).select(*_split(df), "change", "n")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """References, orphans and waiting orphans per table, field and month of seen_at."""
    df = snapshot(_maintained(spark, d)[0]).filter("n_refs > 0")
    return df.select(*_split(df), F.date_format("period", "yyyy-MM").alias("period"), "n_refs", "n_orphans", "n_waiting")


def p7_waiting(spark: SparkSession, d: str) -> DataFrame:
    """Orphans waiting at the end of every month, months without references too."""
    df = snapshot(_maintained(spark, d)[0])
    return df.select(*_split(df), F.date_format("period", "yyyy-MM").alias("period"), "n_waiting")


QUERIES = {"p7_found": p7_found, "p7_changes": p7_changes, "p7_report": p7_report, "p7_waiting": p7_waiting}

_REFS = r"""
with nodes as (
  select lower(regexp_replace(paper_id, '^\s+|\s+$', '', 'g')) k, added_at a, removed_at r from paper_nodes
  union all select lower(regexp_replace(paper_id, '^\s+|\s+$', '', 'g')), timestamp '0001-01-01', null from baseline_nodes),
bibs as (
  select lower(regexp_replace(paper_id, '^\s+|\s+$', '', 'g')) p,
    regexp_replace(lower(regexp_replace(bib_key, '^\s+|\s+$', '', 'g')), '^#\s*', '') k, added_at a, removed_at r from bib_entries),
inl as (
  select ref_id, seen_at, lower(regexp_replace(paper_id, '^\s+|\s+$', '', 'g')) p,
    regexp_replace(lower(regexp_replace(bib_key, '^\s+|\s+$', '', 'g')), '^#\s*', '') k from inline_refs where bib_key is not null),
ends as (
  select edge_id, seen_at, 'source_id' f, lower(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) k from citation_edges where source_id is not null
  union all select edge_id, seen_at, 'target_id', lower(regexp_replace(target_id, '^\s+|\s+$', '', 'g')) from citation_edges where target_id is not null),
"""
_FOUND = _REFS + """found as (
  select 'inline_refs' ref_table, 'bib_key' ref_field, ref_id row_id, seen_at from inl where not exists
    (select 1 from bibs where bibs.p = inl.p and bibs.k = inl.k and a <= seen_at and (r is null or r > seen_at))
  union all select 'citation_edges', f, edge_id, seen_at from ends where not exists
    (select 1 from nodes where nodes.k = ends.k and a <= seen_at and (r is null or r > seen_at)))
"""
_REPORT = _FOUND + """, refs as (
  select 'inline_refs' ref_table, 'bib_key' ref_field, p || chr(31) || k k, seen_at from inl
  union all select 'citation_edges', f, k, seen_at from ends),
par as (select 'inline_refs' t, p || chr(31) || k k, a, r from bibs union all select 'citation_edges', k, a, r from nodes),
ids as (select *, row_number() over () i from refs),
months as (select distinct date_trunc('month', seen_at) m from refs),
wait as (
  select ref_table, ref_field, m, count(*) n from ids, months where seen_at < m + interval 1 month and not exists
    (select 1 from par where par.t = ids.ref_table and par.k = ids.k and a < m + interval 1 month and (r is null or r >= m + interval 1 month))
  group by all),
seen as (select ref_table, ref_field, date_trunc('month', seen_at) m, count(*) n from refs group by all),
lost as (select ref_table, ref_field, date_trunc('month', seen_at) m, count(*) n from found group by all)
select ref_table, ref_field, strftime(m, '%Y-%m') as period, seen.n n_refs, coalesce(lost.n, 0) n_orphans, coalesce(wait.n, 0) n_waiting
from seen left join lost using (ref_table, ref_field, m) left join wait using (ref_table, ref_field, m)
"""
_CHANGES = _FOUND + """, y as (select date_trunc('month', max(seen_at)) - interval 6 month y from (select seen_at from inl union all select seen_at from ends))
select ref_table, ref_field, 'orphan' change, count(*) n from found where seen_at >= (select y from y) group by all
"""
_WAITING = _REPORT.replace("months as (select distinct date_trunc('month', seen_at) m from refs)", "months as (select unnest(generate_series((select date_trunc('month', min(seen_at)) from refs), (select max(seen_at) from refs), interval 1 month)) m)")
_WAITING = _WAITING[: _WAITING.rindex("select ref_table")] + """, firsts as (select ref_table, ref_field, min(m) f from seen group by all)
select ref_table, ref_field, strftime(months.m, '%Y-%m') as period, coalesce(wait.n, 0) n_waiting
from firsts join months on months.m >= f left join wait using (ref_table, ref_field, m)
"""
ORACLES = {"p7_changes": _CHANGES, "p7_waiting": _WAITING, "p7_found": _FOUND + "select ref_table, ref_field, row_id from found", "p7_report": _REPORT}
