"""Identifiers of papers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def normalize_doi(c: Column) -> Column:
    """Trimmed lower case without resolver prefix; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def normalize_arxiv(c: Column) -> Column:
    """Without scheme, category in brackets and version; empty is null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^arxiv:\s*", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s*\[[^\]]*\]\s*", ""), r"v[0-9]+$", "")
    return F.nullif(F.trim(s), F.lit(""))


def normalize_title(c: Column) -> Column:
    """Lower case ASCII letters, digits and single blanks; null becomes empty."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def title_hash(c: Column) -> Column:
    return F.substring(F.sha2(normalize_title(c), 256), 1, 16)


def paper_id(doi: Column, arxiv: Column, title: Column) -> Column:
    """doi: before arxiv: before title: and its hash; a constant without any of them."""
    unknown = F.concat(F.lit("unknown:"), F.substring(F.sha2(F.lit("unknown"), 256), 1, 8))
    named = F.when(F.length(title) > 0, F.concat(F.lit("title:"), title_hash(title)))
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), F.concat(F.lit("arxiv:"), normalize_arxiv(arxiv)), named, unknown)


def node_key(c: Column) -> Column:
    """A tagged id in one notation; empty is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def canonical_url(arxiv: Column, openreview: Column, doi: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), arxiv), F.concat(F.lit("https://openreview.net/forum?id="), openreview), F.concat(F.lit("https://doi.org/"), doi))


def lookup_id(arxiv: Column, doi: Column) -> Column:
    """Key of a paper in an external index: arXiv id before DOI."""
    return F.coalesce(F.concat(F.lit("ARXIV:"), arxiv), F.concat(F.lit("DOI:"), doi))


def url_kind(url: Column) -> Column:
    """arxiv, doi, openreview, biorxiv, medrxiv, ssrn or null, first fit wins."""
    u = F.lower(F.trim(url))
    tests = (
        ("arxiv", r"^https?://arxiv\.org/(abs|pdf)/[\w./-]+/?$"),
        ("doi", r"^https?://(dx\.)?doi\.org/.+$"),
        ("openreview", r"^https?://openreview\.net/(forum|pdf)\?id=[\w-]+"),
        ("biorxiv", r"^https?://(www\.)?biorxiv\.org/content/10\.[0-9]+/.+$"),
        ("medrxiv", r"^https?://(www\.)?medrxiv\.org/content/10\.[0-9]+/.+$"),
        ("ssrn", r"^https?://(papers\.)?ssrn\.com/sol3/papers\.cfm\?abstract_id=[0-9]+"),
    )
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(tests):
        out = F.when(u.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def url_value(url: Column) -> Column:
    """The identifier that a recognised URL carries (an SSRN number as its DOI)."""
    u, kind = F.trim(url), url_kind(url)
    content = F.regexp_replace(F.regexp_extract(u, r"(?i)/content/(10\.[0-9]+/.+)$", 1), r"(?i)(v[0-9]+)?(\.full)?(\.pdf)?/?$", "")
    return (
        F.when(kind == "arxiv", F.regexp_replace(F.regexp_extract(u, r"(?i)arxiv\.org/(?:abs|pdf)/([\w./-]+)$", 1), r"(?i)(v[0-9]+)?(\.pdf)?/?$", ""))
        .when(kind == "doi", F.regexp_extract(u, r"(?i)doi\.org/(.+)$", 1))
        .when(kind == "openreview", F.regexp_extract(u, r"(?i)\?id=([\w-]+)", 1))
        .when(kind.isin("biorxiv", "medrxiv"), content)
        .when(kind == "ssrn", F.concat(F.lit("10.2139/ssrn."), F.regexp_extract(u, r"(?i)abstract_id=([0-9]+)", 1)))
    )


def arxiv_of_doi(doi: Column) -> Column:
    """The arXiv id inside an arXiv DOI, else null."""
    return normalize_arxiv(F.nullif(F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1), F.lit("")))


def preprint_url(doi: Column, open_access_url: Column, version: Column) -> Column:
    """PDF address at a preprint server by DOI prefix, null for other DOIs."""
    d, v = F.lower(doi), F.coalesce(version, F.lit(1)).cast("string")
    host = F.when(F.coalesce(open_access_url, F.lit("")).contains("medrxiv.org"), "medrxiv").otherwise("biorxiv")
    ssrn = F.regexp_extract(d, r"^10\.2139/ssrn\.([0-9]+)", 1)
    osf = F.regexp_extract(doi, r"(?i)^10\.[0-9]+/osf\.io/(\w+)", 1)
    return (
        F.when(d.startswith("10.1101/"), F.concat(F.lit("https://www."), host, F.lit(".org/content/"), doi, F.lit("v"), v, F.lit(".full.pdf")))
        .when(d.startswith("10.2139/") & (ssrn != ""), F.concat(F.lit("https://papers.ssrn.com/sol3/Delivery.cfm/SSRN_ID"), ssrn, F.lit("_code.pdf?abstractid="), ssrn))
        .when(d.rlike(r"^10\.(31234|31224|31220)/") & (osf != ""), F.concat(F.lit("https://osf.io/"), osf, F.lit("/download")))
        .when(d.startswith("10.26434/"), F.concat(F.lit("https://chemrxiv.org/engage/api-gateway/chemrxiv/assets/orp/resource/item/"), doi, F.lit("/original")))
    )
