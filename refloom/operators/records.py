"""Records of outside indexes in one form: nested payloads, wrapped values, links in pages, nodes of citing papers.

Defined cases
- text that is no JSON, null payloads, fields that lack: null fields, no error.
- a record without title and identifiers names no paper and gives no node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from refloom.functions.ids import canonical_url, lookup_id, normalize_arxiv, normalize_doi, paper_id
from refloom.functions.texts import from_inverted_index

#: Shapes of two kinds of payloads; fixed values.
CITATION_INDEX = "paperId string, title string, year int, publicationDate string, abstract string, citationCount int, externalIds map<string, string>, authors array<struct<name: string>>, openAccessPdf struct<url: string>"
WORK_INDEX = (
    "doi string, title string, publication_year int, publication_date string, cited_by_count int, authorships array<struct<author: struct<display_name: string>>>, "
    "abstract_inverted_index map<string, array<int>>, best_oa_location struct<pdf_url: string, landing_page_url: string>"
)
FIELDS = ("title", "year", "publication_date", "doi", "arxiv_id", "abstract", "citation_count", "authors", "open_access_url")


def _named(people: Column) -> Column:
    return F.filter(F.coalesce(people, F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")


def from_citation_index(payload: Column) -> dict[str, Column]:
    """Fields of a citation index's record."""
    p = F.from_json(payload, CITATION_INDEX)
    return {
        "title": p["title"], "year": p["year"], "publication_date": p["publicationDate"], "doi": normalize_doi(p["externalIds"]["DOI"]), "arxiv_id": normalize_arxiv(p["externalIds"]["ArXiv"]),
        "abstract": p["abstract"], "citation_count": p["citationCount"], "authors": _named(F.transform(p["authors"], lambda a: a["name"])), "open_access_url": p["openAccessPdf"]["url"],
    }


def from_work_index(payload: Column) -> dict[str, Column]:
    """Fields of a work index's record; its abstract is a map of words to positions."""
    p = F.from_json(payload, WORK_INDEX)
    return {
        "title": p["title"], "year": p["publication_year"], "publication_date": p["publication_date"], "doi": normalize_doi(p["doi"]), "arxiv_id": F.lit(None).cast("string"),
        "abstract": F.nullif(from_inverted_index(p["abstract_inverted_index"]), F.lit("")), "citation_count": p["cited_by_count"],
        "authors": _named(F.transform(p["authorships"], lambda a: a["author"]["display_name"])), "open_access_url": F.coalesce(p["best_oa_location"]["pdf_url"], p["best_oa_location"]["landing_page_url"]),
    }


def normalized(payloads: DataFrame, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """Adds the common fields to rows whose ``kind`` is ``citation_index`` or ``work_index``; others get nulls."""
    a, b = from_citation_index(F.col(payload)), from_work_index(F.col(payload))
    return payloads.withColumns({f: F.when(F.col(kind) == "citation_index", a[f]).when(F.col(kind) == "work_index", b[f]) for f in FIELDS})


def unwrapped(payload: Column, field: str) -> Column:
    """A field that stands plainly or within ``{"value": ...}``, as a string."""
    v = F.try_parse_json(payload)
    return F.coalesce(F.try_variant_get(v, f"$.{field}.value", "string"), F.when(~F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit("{")).startswith("{"), F.try_variant_get(v, f"$.{field}", "string")))


def embedded_link(page: Column, base: Column) -> Column:
    """Address of the file that a page embeds (embed or iframe source, or a button's target), made absolute; null if none."""
    src = F.regexp_extract(page, r"""(?i)<(?:embed|iframe)\b[^>]*?\bsrc\s*=\s*["']([^"'#]+)""", 1)
    click = F.regexp_extract(page, r"""(?i)\bonclick\s*=\s*["'][^"']*?location\.href\s*=\s*\\?['"]([^'"\\]+)""", 1)
    link = F.coalesce(F.nullif(src, F.lit("")), F.nullif(click, F.lit("")))
    scheme, host = F.regexp_extract(base, r"^(https?:)//", 1), F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(host, link)).otherwise(link)


def citing_nodes(records: DataFrame) -> DataFrame:
    """(id, title, year, url, lookup, status) of citing papers (title, year, doi, arxiv_id); rows without title and ids are left out."""
    doi, arxiv = normalize_doi(F.col("doi")), normalize_arxiv(F.col("arxiv_id"))
    known = (F.length(F.trim(F.coalesce("title", F.lit("")))) > 0) | doi.isNotNull() | arxiv.isNotNull()
    return records.filter(known).select(
        "*", paper_id(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("id"), canonical_url(arxiv, F.lit(None).cast("string"), doi).alias("node_url"), lookup_id(arxiv, doi).alias("lookup"), F.lit("analyzed").alias("node_status"),
    )


def resolve_by_ids(bib: DataFrame, records: DataFrame) -> DataFrame:
    """(entry_id, rec_id, by): the record with the entry's DOI, else its arXiv id, else its whole title; the smallest record id of each."""
    from refloom.functions.ids import normalize_title

    one = lambda c, k: records.select("rec_id", c.alias(k)).filter(F.coalesce(F.col(k), F.lit("")) != "").groupBy(k).agg(F.min("rec_id").alias(f"r_{k}"))
    keys = {"d": normalize_doi(F.col("doi")), "a": normalize_arxiv(F.col("arxiv_id")), "t": normalize_title(F.col("title"))}
    b = bib.select("entry_id", *(F.nullif(c, F.lit("")).alias(k) for k, c in keys.items()))
    for k, c in keys.items():
        b = b.join(one(c, k), k, "left")
    by = F.when(F.col("r_d").isNotNull(), "doi").when(F.col("r_a").isNotNull(), "arxiv").when(F.col("r_t").isNotNull(), "title")
    return b.select("entry_id", F.coalesce("r_d", "r_a", "r_t").alias("rec_id"), by.alias("by")).filter("rec_id is not null")
