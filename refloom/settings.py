"""Every threshold in one place; pass a changed copy (``dataclasses.replace``) or set ``REFLOOM_`` variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Thresholds of the operators; fixed values where results must agree with other tools."""

    math_noise_chars: int = 3
    stem_from: int = 5
    stem_drops: int = 2
    semantic_chars: int = 10
    semantic_least: float = 0.40
    search_least: float = 85.0
    search_years_apart: int = 3
    year_gap: int = 2
    first_year: int = 1970
    last_year: int = 2026
    link_least: float = 88.0
    link_chars: int = 15
    query_words: int = 8
    query_word_chars: int = 4
    phrase_candidates: int = 5
    keyword_candidates: int = 10
    batch_keys: int = 50
    depth_forward: int = 3
    depth_reverse: int = 1
    citing_rows: int = 500
    pivot_multiple: float = 2.0
    context_title_chars: int = 120
    breaker_failures: int = 3
    breaker_open_seconds: int = 120


SETTINGS = Settings()
PREFIX = "REFLOOM_"


def read_file(path: str | Path) -> dict[str, str]:
    """``name = value`` lines of a file; comments, blank lines and quotes are dropped. A missing file is empty."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.partition("=")
            if eq and not name.lstrip().startswith("#"):
                out[name.strip().lower()] = value.strip().strip("\"'")
    return out


def load(given: dict[str, object] | None = None, env: dict[str, str] | None = None, path: str | Path | None = None) -> Settings:
    """Settings by priority: ``given`` before environment before file before default.

    Unknown names and values that are no numbers raise ValueError; null in ``given`` means not given.
    """
    env = dict(os.environ) if env is None else env
    names = {f.name: type(getattr(SETTINGS, f.name)) for f in fields(Settings)}
    from_env = {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)}
    asked = (read_file(path) if path else {}) | from_env | {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := sorted(set(asked) - set(names)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(SETTINGS, **{k: names[k](v) for k, v in asked.items()})
