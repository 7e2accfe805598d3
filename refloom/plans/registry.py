"""Query name -> callable, and query name -> checking SQL."""

from __future__ import annotations

from refloom.plans import graph_queries, integrity_queries, meta_queries, text_queries, trace_queries

MODULES = [text_queries, graph_queries, meta_queries, trace_queries, integrity_queries]
FLAGSHIP = "kw_sentence_hits"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
