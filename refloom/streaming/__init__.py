"""Continuous monitoring of arriving citations."""
