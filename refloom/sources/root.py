"""Where a trace starts: one file, identifier or address, and the files a user supplies."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Shapes of addresses, in order of precedence.
URLS = (
    ("arxiv", r"https?://arxiv\.org/(?:abs|pdf)/([\w./-]+?)(?:v\d+)?(?:\.pdf)?/?$"),
    ("doi", r"https?://(?:dx\.)?doi\.org/(.+)$"),
    ("openreview", r"https?://openreview\.net/(?:forum|pdf)\?id=([\w-]+)"),
    ("biorxiv", r"https?://(?:www\.)?biorxiv\.org/content/(10\.\d+/.+?)(?:v\d+)?(?:\.full)?(?:\.pdf)?/?$"),
    ("medrxiv", r"https?://(?:www\.)?medrxiv\.org/content/(10\.\d+/.+?)(?:v\d+)?(?:\.full)?(?:\.pdf)?/?$"),
    ("ssrn", r"https?://(?:papers\.)?ssrn\.com/sol3/papers\.cfm\?abstract_id=(\d+)"),
)


def route_url(url: str) -> tuple[str, str]:
    """(kind, identifier) of an address: arxiv, openreview or doi (preprint servers have DOIs); anything else raises ValueError."""
    for kind, shape in URLS:
        if m := re.match(shape, url.strip(), re.IGNORECASE):
            if kind == "ssrn":
                return "doi", f"10.2139/ssrn.{m[1]}"
            return (kind, m[1]) if kind in ("arxiv", "openreview") else route_doi(m[1])
    raise ValueError(f"address of no known kind: {url!r}")


def route_doi(doi: str) -> tuple[str, str]:
    """A DOI, or the arXiv id inside an arXiv DOI."""
    bare = re.sub(r"^https?://(dx\.)?doi\.org/", "", doi.strip(), flags=re.IGNORECASE)
    m = re.match(r"10\.48550/arxiv\.(.+)$", bare, re.IGNORECASE)
    return ("arxiv", re.sub(r"v\d+$", "", m[1])) if m else ("doi", bare.lower())


def root_source(pdf: str | None = None, doi: str | None = None, arxiv_id: str | None = None, url: str | None = None) -> tuple[str, str]:
    """(kind, value) of the one input that is given; none or several raise ValueError."""
    given = {k: v for k, v in (("pdf", pdf), ("doi", doi), ("arxiv", arxiv_id), ("url", url)) if v and v.strip()}
    if len(given) != 1:
        raise ValueError(f"one of pdf, doi, arxiv_id and url is needed, not {len(given)}")
    kind, value = next(iter(given.items()))
    if kind == "url":
        return route_url(value)
    if kind == "doi":
        return route_doi(value)
    return kind, re.sub(r"^arxiv:\s*|v\d+$", "", value.strip(), flags=re.IGNORECASE) if kind == "arxiv" else value.strip()


def root_id(kind: str, value: str) -> str:
    """The tagged id of a root; a file has none and raises ValueError."""
    if kind not in ("doi", "arxiv", "openreview"):
        raise ValueError("a file alone names no paper")
    return f"{kind}:{value.lower()}"


def supplied_files(items: Iterable[str]) -> dict[str, str]:
    """``ID=PATH`` or ``ID=URL`` items as a map; the first ``=`` parts, later items win. Anything else raises ValueError."""
    out = {}
    for item in items:
        name, eq, path = item.partition("=")
        if not eq or not name.strip() or not path.strip():
            raise ValueError(f"not ID=PATH: {item!r}")
        out[name.strip().lower()] = path.strip()
    return out
