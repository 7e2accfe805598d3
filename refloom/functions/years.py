"""Choosing between years of one paper. The latest plausible year is a parameter, so results do not depend on today."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from refloom.settings import SETTINGS

FIRST_YEAR, GAP = SETTINGS.first_year, SETTINGS.year_gap


def plausible(year: Column, last_year: int) -> Column:
    return F.coalesce(year.between(FIRST_YEAR, last_year), F.lit(False))


def older_within_gap(anchor: Column, candidate: Column, last_year: int, gap: int = GAP) -> Column:
    """The candidate if it is plausible and at most ``gap`` years before a plausible anchor (or there is none)."""
    keep = (candidate >= anchor) | (anchor - candidate > gap)
    return F.when(~plausible(candidate, last_year), anchor).when(~plausible(anchor, last_year), candidate).when(keep, anchor).otherwise(candidate)


def better_candidate(anchor: Column, candidate: Column, last_year: int, gap: int = GAP) -> Column:
    """The candidate where it may lower a year anchored at ``anchor``, else null; take the least of many."""
    fits = plausible(candidate, last_year) & (anchor.isNull() | ((candidate < anchor) & (anchor - candidate <= gap)))
    return F.when(fits, candidate)
