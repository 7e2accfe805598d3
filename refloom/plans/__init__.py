"""Plan-level helpers: lineage cuts, skew-aware joins, session settings."""
