"""Operators for preparing text corpora and deduplicating records."""
