"""Queries and checking SQL of the problems tagged llm."""

from __future__ import annotations

from refloom.llm import q_bpe, q_cascade, q_copies, q_mixing, q_names, q_scan_noise, q_sentences, q_survivors, q_truncation

MODULES = [q_copies, q_survivors, q_sentences, q_cascade, q_names, q_scan_noise, q_truncation, q_bpe, q_mixing]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
