"""Queries over identifiers, resolution, snapshots and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from refloom.functions import ids as I
from refloom.functions import years as Y
from refloom.operators import diff as D
from refloom.operators import records as N
from refloom.operators import resolve as R
from refloom.plans.graph_queries import EV, NV, _edges, _nodes
from refloom.plans.lineage import cut
from refloom.sources.tables import table

LAST_YEAR, SINCE, SNAPSHOT = 2026, "2015-06", "2025-01-01"


def paper_ids(spark: SparkSession, d: str) -> DataFrame:
    """Normalised identifiers, title and canonical id of every entry."""
    b = table(spark, d, "bib_entries")
    doi, arx = I.normalize_doi(F.col("doi")), I.normalize_arxiv(F.col("arxiv_id"))
    return b.select(
        "entry_id", doi.alias("doi"), arx.alias("arxiv"), I.normalize_title(F.col("title")).alias("title"), I.paper_id(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("paper"),
        I.canonical_url(arx, F.lit(None).cast("string"), doi).alias("url"), I.lookup_id(arx, doi).alias("lookup"),
    )


_SITES = ("https://doi.org/10.1/", "http://arxiv.org/abs/1234.", "https://openreview.net/forum?id=", "https://www.biorxiv.org/content/10.1101/", "https://medrxiv.org/content/10.1101/", "https://papers.ssrn.com/sol3/papers.cfm?abstract_id=", "https://example.org/", "HTTPS://ARXIV.ORG/PDF/0001.")


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every site, made from the entries' numbers."""
    site = F.element_at(F.array(*(F.lit(s) for s in _SITES)), (F.pmod("entry_id", F.lit(len(_SITES))) + 1).cast("int"))
    return table(spark, d, "bib_entries").select("entry_id", F.concat(site, F.col("entry_id").cast("string"), F.when(F.pmod("entry_id", F.lit(3)) == 0, "v2.full.pdf").otherwise("")).alias("url"))


def url_router(spark: SparkSession, d: str) -> DataFrame:
    """Kind and identifier of addresses."""
    return _urls(spark, d).select("entry_id", I.url_kind(F.col("url")).alias("kind"), I.url_value(F.col("url")).alias("value"))


_PREFIX = ("10.1101/", "10.2139/ssrn.", "10.31234/osf.io/", "10.31224/osf.io/", "10.31220/osf.io/", "10.26434/", "10.48550/arxiv.", "10.5555/")


def preprint_urls(spark: SparkSession, d: str) -> DataFrame:
    """Preprint addresses by DOI prefix, with the latest version of each paper, and arXiv ids inside DOIs."""
    pre = F.element_at(F.array(*(F.lit(p) for p in _PREFIX)), (F.pmod("rec_id", F.lit(len(_PREFIX))) + 1).cast("int"))
    r = table(spark, d, "resolved_refs")
    latest = r.groupBy(F.col("paper_id").alias("p")).agg(F.coalesce(F.max(F.pmod("rec_id", F.lit(4)).cast("int")), F.lit(1)).alias("version"))
    rows = r.select("rec_id", "paper_id", F.concat(pre, F.col("rec_id").cast("string")).alias("doi"), F.when(F.pmod("rec_id", F.lit(2)) == 0, "https://www.medrxiv.org/x").alias("oa"))
    j = rows.join(latest, F.col("paper_id").eqNullSafe(F.col("p")), "left")
    return j.select("rec_id", I.preprint_url(F.col("doi"), F.col("oa"), F.greatest("version", F.lit(1))).alias("url"), I.arxiv_of_doi(F.col("doi")).alias("arxiv"))


def year_backfill_min(spark: SparkSession, d: str) -> DataFrame:
    """The least plausible year that entries give a node, within two years below its first one."""
    n = _nodes(spark, d).select("id", "doi", "arxiv_id", "added_at", "original_year", "year")
    b = table(spark, d, "bib_entries").withColumn("paper_id", I.node_key(F.col("paper_id")))
    links = R.exact_links(b, n).select(F.col("target").alias("id"), F.col("year").alias("cand"))
    j = n.join(links, "id").withColumn("c", Y.better_candidate(F.col("original_year"), F.col("cand"), LAST_YEAR))
    return j.groupBy("id").agg(F.min("year").alias("year"), F.min("c").alias("c")).select("id", F.least("year", "c").alias("year"))


def year_backfill_last(spark: SparkSession, d: str) -> DataFrame:
    """The year after the last delivery of each paper: it replaces the first one only if older within two years."""
    r = table(spark, d, "resolved_refs").filter("paper_id is not null")
    w = r.groupBy("paper_id").agg(F.min_by("pub_year", F.struct("retrieved_at", "rec_id")).alias("anchor"), F.max_by("pub_year", F.struct("retrieved_at", "rec_id")).alias("cand"))
    return w.select("paper_id", Y.older_within_gap(F.col("anchor"), F.col("cand"), LAST_YEAR).alias("year"))


def secondary_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links that only bibliographies show."""
    e = _edges(spark, d)
    b = table(spark, d, "bib_entries").withColumn("paper_id", I.node_key(F.col("paper_id")))
    papers = table(spark, d, "papers").select(I.node_key(F.col("paper_id")).alias("id"), F.lit(0).alias("depth"), "doi", "arxiv_id", F.col("parsed_at").alias("added_at"))
    nodes = _nodes(spark, d).select("id", "depth", "doi", "arxiv_id", "added_at")
    both = nodes.unionByName(papers.join(nodes, "id", "left_anti"))
    return R.secondary_edges(b, both, e.filter("edge_type = 'primary'"))


def fuzzy_title_best(spark: SparkSession, d: str) -> DataFrame:
    """For each paper and node the entry whose title fits best."""
    b = table(spark, d, "bib_entries").withColumn("paper_id", I.node_key(F.col("paper_id")))
    return R.fuzzy_links(b, _nodes(spark, d), _edges(spark, d).filter("edge_type = 'primary'")).select("src", "dst", "entry_id", F.round("score", 4).alias("score"))


def title_search_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Entries without identifiers, searched by title at one provider after the other."""
    b = table(spark, d, "bib_entries").filter("title is not null and doi is null and arxiv_id is null")
    c = table(spark, d, "resolved_refs").select("rec_id", "title", "pub_year", "provider")
    out = None
    for no, (provider, rule, first) in enumerate((("preprint_api", "after", False), ("index_a", "before", False), ("review_site", "none", False), ("index_b", "none", True))):
        hit = cut(R.title_search(b, c.filter(F.col("provider") == provider), rule, first).withColumn("stage", F.lit(no)))
        b = b.join(hit.select("entry_id"), "entry_id", "left_anti")  # later providers are asked for the rest only
        out = hit if out is None else out.unionByName(hit)
    return out.select("entry_id", "rec_id", "stage", F.round("score", 4).alias("score"))


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """One record per paper, each field from the most trusted provider that has it."""
    r = table(spark, d, "resolved_refs").filter("paper_id is not null").join(F.broadcast(table(spark, d, "providers")), "provider", "left")  # a row per provider
    rank = [F.coalesce("trust_rank", F.lit(99)), F.col("rec_id")]
    return R.coalesce_records(r, "paper_id", rank, ["title", "pub_year", "doi", "arxiv_id", "openreview_id", "abstract", "citation_count"])


def availability_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Where the full text of every record can be had, supplied files first."""
    supplied = table(spark, d, "baseline_nodes").select(F.col("paper_id").alias("s_id"), F.concat(F.lit("file:/"), "paper_id").alias("supplied")).distinct()
    r = table(spark, d, "resolved_refs").join(F.broadcast(supplied), F.col("paper_id") == F.col("s_id"), "left")  # fixed table
    kind, at = R.location(F.col("pdf_path"), F.col("supplied"), I.normalize_arxiv(F.col("arxiv_id")), F.nullif("openreview_id", F.lit("")), F.col("url"), I.preprint_url(F.col("doi"), F.col("url"), F.lit(1)))
    return r.select("rec_id", kind.alias("kind"), at.alias("address"), at.isNotNull().alias("available"))


def batch_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with gaps filled from records of the same DOI."""
    e = R.enrich(_nodes(spark, d), table(spark, d, "resolved_refs"))
    return e.select("id", F.col("d").alias("doi"), F.length("abstract").alias("abstract_chars"), "citation_count", "year", F.array_join("authors", "; ").alias("authors"), "found")


def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    """DOIs of nodes in requests of fifty."""
    return R.chunks(_nodes(spark, d).select(I.normalize_doi(F.col("doi")).alias("doi")), "doi")


def negative_cache(spark: SparkSession, d: str) -> DataFrame:
    """DOIs of nodes that no record returned: to be remembered as absent."""
    n = _nodes(spark, d).select(I.normalize_doi(F.col("doi")).alias("doi")).filter("doi is not null").distinct()
    return n.join(table(spark, d, "resolved_refs").select(I.normalize_doi(F.col("doi")).alias("doi")), "doi", "left_anti")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of cache writes; small values stand for known misses."""
    return table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("key"), F.when(F.col("value") >= 10, F.col("props")).alias("data"), "ts", "event_id")


def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last write of every cache key."""
    return R.latest(_cache(spark, d), ["source", "key"], ["ts", "event_id"]).select("source", "key", "event_id", "data")


def cache_three_state(spark: SparkSession, d: str) -> DataFrame:
    """State of every customer's key at every source: hit, known miss or never asked."""
    c = R.latest(_cache(spark, d), ["source", "key"], ["ts", "event_id"])
    src = c.select("source").distinct()  # a row per event type
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("key")).join(F.broadcast(src))
    return R.lookup_cache(probes, c, ["source", "key"]).select("source", "key", "state")


def cache_purge_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The cache without known misses of two sources."""
    c = R.latest(_cache(spark, d), ["source", "key"], ["ts", "event_id"])
    return c.filter(F.col("data").isNotNull() | ~F.col("source").isin("click", "view")).select("source", "key", "event_id")


def cache_fast_path(spark: SparkSession, d: str) -> DataFrame:
    """Papers answered from stored results, and those to be resolved anew."""
    stored = table(spark, d, "resolved_refs").filter("pdf_path is not null").groupBy("paper_id").agg(F.min("rec_id").alias("rec_id"))
    want = table(spark, d, "paper_nodes").select("paper_id").filter("paper_id is not null").distinct()
    return want.join(stored, "paper_id", "left").select("paper_id", F.when(F.col("rec_id").isNotNull(), "cached").otherwise("resolve").alias("path"), "rec_id")


def props_values(spark: SparkSession, d: str) -> DataFrame:
    """First field, number of fields and validity of JSON payloads."""
    v = F.try_parse_json("props")
    first = F.get(F.json_object_keys("props"), F.lit(0))
    return table(spark, d, "events").select("event_id", first.alias("field"), F.size(F.json_object_keys("props")).alias("n_fields"), v.isNotNull().alias("valid"))


def wrapped_values(spark: SparkSession, d: str) -> DataFrame:
    """Titles from payloads in which every other one is wrapped, and every fifth payload is broken."""
    t = table(spark, d, "bib_entries").filter("title is not null").select("entry_id", "title")
    plain, wrapped = F.to_json(F.struct("title")), F.to_json(F.struct(F.struct(F.col("title").alias("value")).alias("title")))
    payload = F.when(F.pmod("entry_id", F.lit(5)) == 0, F.lit("{broken")).when(F.pmod("entry_id", F.lit(2)) == 0, wrapped).otherwise(plain)
    return t.select("entry_id", N.unwrapped(payload, "title").alias("title"))


def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as two indexes would send them, brought back into one form."""
    r = table(spark, d, "resolved_refs")
    words = F.map_from_entries(F.transform(F.array_distinct(F.split("t", " ")), lambda w: F.struct(w.alias("k"), F.filter(F.transform(F.split("t", " "), lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("v"))))
    r = r.withColumn("t", F.trim(F.regexp_replace("abstract", r"\s+", " ")))
    ids = F.create_map(F.lit("DOI"), F.col("doi"), F.lit("ArXiv"), F.col("arxiv_id"))
    a = F.to_json(F.struct("title", F.col("pub_year").alias("year"), F.col("publication_date").alias("publicationDate"), "abstract", F.col("citation_count").alias("citationCount"), ids.alias("externalIds"), F.transform("authors", lambda x: F.struct(x.alias("name"))).alias("authors"), F.struct("url").alias("openAccessPdf")))
    b = F.to_json(
        F.struct(
            "doi", "title", F.col("pub_year").alias("publication_year"), "publication_date", F.col("citation_count").alias("cited_by_count"), F.transform("authors", lambda x: F.struct(F.struct(x.alias("display_name")).alias("author"))).alias("authorships"),
            words.alias("abstract_inverted_index"), F.struct(F.lit(None).cast("string").alias("pdf_url"), F.col("url").alias("landing_page_url")).alias("best_oa_location"),
        )
    )
    odd = F.pmod("rec_id", F.lit(2)) == 1
    sent = r.select("rec_id", F.when(odd, "citation_index").otherwise("work_index").alias("kind"), F.when(odd, a).otherwise(b).alias("payload"))
    n = N.normalized(sent)
    return n.select("rec_id", "kind", "title", "year", "publication_date", "doi", "arxiv_id", F.length("abstract").alias("abstract_chars"), "citation_count", F.array_join("authors", "; ").alias("authors"), F.col("open_access_url").alias("url"))


def embedded_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to files inside pages that embed them in several ways."""
    r = table(spark, d, "resolved_refs").select("rec_id")
    name, kind = F.concat(F.lit("file"), F.col("rec_id"), F.lit(".pdf")), F.pmod("rec_id", F.lit(4))
    link = F.when(kind == 0, F.concat(F.lit("//cdn.example.org/"), name)).when(kind == 1, F.concat(F.lit("/store/"), name)).when(kind == 2, F.concat(F.lit("https://x.example.org/"), name))
    page = F.when(kind == 1, F.concat(F.lit("<button onclick=\"location.href='"), link, F.lit("'\">get</button>"))).otherwise(F.concat(F.lit('<html><embed type="application/pdf" src="'), link, F.lit('#view=fit"></html>')))
    return r.select("rec_id", N.embedded_link(F.coalesce(page, F.lit("<html>nothing</html>")), F.lit("https://site.example.org/a/b")).alias("link"))


def citing_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of citing records; those that name no paper are left out."""
    r = table(spark, d, "resolved_refs").select("rec_id", "title", F.col("pub_year").alias("year"), "doi", "arxiv_id")
    return N.citing_nodes(r).select("rec_id", "id", "year", F.col("node_url").alias("url"), "lookup", F.col("node_status").alias("status"))


def resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    """Entries resolved by DOI, else arXiv id, else whole title."""
    return N.resolve_by_ids(table(spark, d, "bib_entries"), table(spark, d, "resolved_refs"))


def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Records that an index would offer for each entry's title, by phrase, else by words."""
    b = table(spark, d, "bib_entries").filter("title is not null")
    return R.title_candidates(b, table(spark, d, "resolved_refs").filter("title is not null"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Latest version of every preprint, one where none is known."""
    r = table(spark, d, "resolved_refs").select("paper_id", F.pmod("rec_id", F.lit(4)).cast("int").cast("string").alias("version"))
    return R.latest_versions(r, "paper_id", "version")


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a circuit breaker of three failures and two minutes would let through, per user."""
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("call"), (F.col("event_type") == "error").alias("failed"))
    return R.breaker(e).select("source", "call", "allowed", "opened")


def breaker_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive failures per user, with the time the circuit would stay open."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("g", F.row_number().over(w) - F.row_number().over(W.partitionBy("user_id", "bad").orderBy("ts", "event_id"))).filter("bad")
    return e.groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("n_failures"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).select("user_id", "n_failures", "first_event", "last_event", (F.col("n_failures") >= 3).alias("opens"))


def diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the baseline lacks and that are recent."""
    base = table(spark, d, "baseline_nodes").select(I.node_key(F.col("paper_id")).alias("id"))
    return D.mark_nodes(_nodes(spark, d).drop("is_new"), base, SINCE).select("id", "is_new", "unknown_date")


def diff_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that the snapshot of an earlier day lacks."""
    from refloom.operators.graph import edge_view

    old = edge_view(table(spark, d, "citation_edges").filter(F.col("seen_at") < F.lit(SNAPSHOT).cast("timestamp_ntz")))
    return D.mark_edges(_edges(spark, d), old).select("src", "dst", "edge_type", "is_new")


def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """New nodes, new edges and nodes of unknown date."""
    n = diff_nodes(spark, d).agg(F.count_if("is_new").alias("new_nodes"), F.count_if("unknown_date").alias("unknown_dates"))
    return n.join(F.broadcast(diff_edges(spark, d).agg(F.count_if("is_new").alias("new_edges"))))  # one row each


def since_filter(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by whether they pass a date: yes, no or unknown."""
    n = _nodes(spark, d)
    return n.select("id", D.passes_since(F.col("year"), F.col("publication_date"), SINCE).alias("passes"))


QUERIES = {f.__name__: f for f in (paper_ids, url_router, preprint_urls, year_backfill_min, year_backfill_last, secondary_edges, fuzzy_title_best, title_search_cascade, resolve_cascade, availability_cascade, batch_enrich, batch_chunks, negative_cache, cache_latest, cache_three_state, cache_purge_negatives, cache_fast_path, props_values, breaker_runs, diff_nodes, diff_edges, diff_counts, since_filter, wrapped_values, normalized_records, embedded_links, citing_nodes, resolve_ids, title_candidates, latest_version, breaker_states)}

_D = lambda c: rf"nullif(regexp_replace(lower(trim({c})), '^https?://(dx\.)?doi\.org/', ''), '')"
_A = lambda c: rf"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^arxiv:\s*', ''), '\s*\[[^\]]*\]\s*', '', 'g'), 'v[0-9]+$', '')), '')"
_T = lambda c: rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_LINKS = f"""dn as (select {_D('doi')} k, arg_max(id, struct_pack(a := added_at, b := id)) t from @N where {_D('doi')} is not null group by 1), an as (select {_A('arxiv_id')} k, arg_max(id, struct_pack(a := added_at, b := id)) t from @N where {_A('arxiv_id')} is not null group by 1),
  lk as (select entry_id, nullif(lower(trim(paper_id)), '') p, bib_key, coalesce(nullif(title, ''), raw, '') label, pub_year, coalesce(dn.t, an.t) t from bib_entries left join dn on dn.k = {_D('doi')} left join an on an.k = {_A('arxiv_id')} where coalesce(dn.t, an.t) <> nullif(lower(trim(paper_id)), ''))"""
_KIND = "case " + " ".join(f"when regexp_matches(lower(trim(url)), '{p}') then '{k}'" for k, p in (("arxiv", r"^https?://arxiv\.org/(abs|pdf)/[\w./-]+/?$"), ("doi", r"^https?://(dx\.)?doi\.org/.+$"), ("openreview", r"^https?://openreview\.net/(forum|pdf)\?id=[\w-]+"), ("biorxiv", r"^https?://(www\.)?biorxiv\.org/content/10\.[0-9]+/.+$"), ("medrxiv", r"^https?://(www\.)?medrxiv\.org/content/10\.[0-9]+/.+$"), ("ssrn", r"^https?://(papers\.)?ssrn\.com/sol3/papers\.cfm\?abstract_id=[0-9]+"))) + " end"
_LOG = "log as (select event_type as source, user_id as key, case when value >= 10 then props end as data, ts, event_id from events), cache as (select * from log qualify row_number() over (partition by source, key order by ts desc, event_id desc) = 1)"
_PASS = "case when regexp_extract(coalesce(publication_date, ''), '^([0-9]{4}-[0-9]{2})', 1) <> '' then regexp_extract(publication_date, '^([0-9]{4}-[0-9]{2})', 1) >= '2015-06' else year >= 2015 end"
_OLD = EV.replace("ev as", "oe as").replace(", pr as (select distinct src, dst from ev)", "").replace("from citation_edges)", f"from citation_edges where seen_at < timestamp '{SNAPSHOT}')")
_DIFF = f"dnodes as (select id, coalesce({_PASS}, false) and id not in (select nullif(lower(trim(paper_id)), '') from baseline_nodes) is_new, ({_PASS}) is null unknown_date from nv), dedges as (select src, dst, edge_type, (src, dst, edge_type) not in (select (src, dst, edge_type) from oe) is_new from ev)"
_FIRST = lambda f, miss: f"(arg_min({f}, struct_pack(a := coalesce(trust_rank, 99), b := rec_id)) filter ({f} is not null and {f} <> {miss})) {f}"
# Words without weight, written out once more for the check.
_STOP = ", ".join(f"'{w}'" for w in "the and for with from into over under this that these those their there where which what when while using based via novel towards toward against".split())
_PRE = "[" + ", ".join(f"'{p}'" for p in _PREFIX) + "]"
ORACLES = {
    "paper_ids": f"""with x as (select entry_id, {_D('doi')} d, {_A('arxiv_id')} a, {_T('title')} t, title raw from bib_entries)
        select entry_id, d doi, a arxiv, t title, coalesce('doi:' || d, 'arxiv:' || a, case when length(raw) > 0 then 'title:' || substr(sha256(t), 1, 16) end, 'unknown:' || substr(sha256('unknown'), 1, 8)) paper,
          coalesce('https://arxiv.org/abs/' || a, 'https://doi.org/' || d) url, coalesce('ARXIV:' || a, 'DOI:' || d) lookup from x""",
    "url_router": f"""with u as (select entry_id, [{', '.join(f"'{s}'" for s in _SITES)}][(entry_id % {len(_SITES)} + 1)::int] || entry_id || case when entry_id % 3 = 0 then 'v2.full.pdf' else '' end url from bib_entries), k as (select *, {_KIND} kind from u)
        select entry_id, kind, case kind when 'arxiv' then regexp_replace(regexp_extract(url, '(?i)arxiv\\.org/(?:abs|pdf)/([\\w./-]+)$', 1), '(?i)(v[0-9]+)?(\\.pdf)?/?$', '') when 'doi' then regexp_extract(url, '(?i)doi\\.org/(.+)$', 1) when 'openreview' then regexp_extract(url, '(?i)\\?id=([\\w-]+)', 1)
          when 'ssrn' then '10.2139/ssrn.' || regexp_extract(url, '(?i)abstract_id=([0-9]+)', 1) when 'biorxiv' then regexp_replace(regexp_extract(url, '(?i)/content/(10\\.[0-9]+/.+)$', 1), '(?i)(v[0-9]+)?(\\.full)?(\\.pdf)?/?$', '')
          when 'medrxiv' then regexp_replace(regexp_extract(url, '(?i)/content/(10\\.[0-9]+/.+)$', 1), '(?i)(v[0-9]+)?(\\.full)?(\\.pdf)?/?$', '') end as value from k""",
    "preprint_urls": f"""with v as (select paper_id p, greatest(coalesce(max(rec_id % 4), 1), 1) ver from resolved_refs group by 1), x as (select rec_id, paper_id, {_PRE}[(rec_id % {len(_PREFIX)} + 1)::int] pre, pre || rec_id doi, rec_id % 2 = 0 med from resolved_refs)
        select rec_id, case pre when '10.1101/' then 'https://www.' || case when med then 'medrxiv' else 'biorxiv' end || '.org/content/' || doi || 'v' || ver || '.full.pdf'
          when '10.2139/ssrn.' then 'https://papers.ssrn.com/sol3/Delivery.cfm/SSRN_ID' || rec_id || '_code.pdf?abstractid=' || rec_id when '10.26434/' then 'https://chemrxiv.org/engage/api-gateway/chemrxiv/assets/orp/resource/item/' || doi || '/original'
          when '10.5555/' then null when '10.48550/arxiv.' then null else 'https://osf.io/' || rec_id || '/download' end url, case when pre = '10.48550/arxiv.' then rec_id::varchar end arxiv from x left join v on paper_id is not distinct from p""",
    "year_backfill_min": f"""with {NV}, {_LINKS.replace('@N', 'nv')}, c as (select nv.id, nv.year, case when lk.pub_year between 1970 and {LAST_YEAR} and (original_year is null or (lk.pub_year < original_year and original_year - lk.pub_year <= 2)) then lk.pub_year end c from nv join lk on lk.t = nv.id)
        select id, least(min(year), min(c)) as year from c group by id""",
    "year_backfill_last": f"""with w as (select paper_id, first(pub_year order by retrieved_at nulls first, rec_id) a, last(pub_year order by retrieved_at nulls first, rec_id) c from resolved_refs where paper_id is not null group by 1)
        select paper_id, case when c is null or c not between 1970 and {LAST_YEAR} then a when a is null or a not between 1970 and {LAST_YEAR} then c when c >= a or a - c > 2 then a else c end as year from w""",
    "secondary_edges": f"""with {NV}, {EV}, bn as (select id, depth, doi, arxiv_id, added_at from nv union all select nullif(lower(trim(paper_id)), ''), 0, doi, arxiv_id, parsed_at from papers where nullif(lower(trim(paper_id)), '') not in (select id from nv)), {_LINKS.replace('@N', 'bn')}
        select p src, t dst, arg_min('bibliographic link (ref ' || bib_key || ': ' || substr(label, 1, 120) || ')', entry_id) context, max(greatest(a.depth, b.depth)) depth from lk join bn a on a.id = p join bn b on b.id = t
        where not exists (select 1 from ev where ev.src = p and ev.dst = t and edge_type = 'primary') group by p, t""",
    "resolve_cascade": f"""select paper_id, {_FIRST('title', "''")}, {_FIRST('pub_year', '0')}, {_FIRST('doi', "''")}, {_FIRST('arxiv_id', "''")}, {_FIRST('openreview_id', "''")}, {_FIRST('abstract', "''")}, {_FIRST('citation_count', '0')}
        from resolved_refs left join providers using (provider) where paper_id is not null group by paper_id""",
    "availability_cascade": f"""with x as (select rec_id, case when paper_id in (select paper_id from baseline_nodes) then 'file:/' || paper_id end s, pdf_path p, 'https://arxiv.org/pdf/' || {_A('arxiv_id')} a, 'https://openreview.net/pdf?id=' || nullif(openreview_id, '') o, url u from resolved_refs)
        select rec_id, case when s is not null then 'supplied' when p is not null then 'stored' when a is not null then 'arxiv' when o is not null then 'openreview' when u is not null then 'open_access' end kind, coalesce(s, p, a, o, u) address, coalesce(s, p, a, o, u) is not null available from x""",
    "batch_enrich": f"""with {NV}, r as (select *, {_D('doi')} d from resolved_refs where d is not null qualify row_number() over (partition by d order by rec_id) = 1)
        select id, {_D('nv.doi')} doi, length(coalesce(nullif(nv.abstract, ''), r.abstract))::int abstract_chars, coalesce(nv.citation_count, r.citation_count) citation_count, coalesce(nullif(nv.year, 0), r.pub_year) as year,
          array_to_string(case when len(nv.authors) > 0 then nv.authors else r.authors end, '; ') authors, r.d is not null found from nv left join r on r.d = {_D('nv.doi')}""",
    "batch_chunks": f"with {NV}, k as (select distinct {_D('doi')} doi from nv where doi is not null) select doi, ((row_number() over (order by doi) - 1) // 50)::bigint chunk from k where doi is not null",
    "negative_cache": f"with {NV}, r as (select {_D('doi')} doi from resolved_refs) select distinct {_D('nv.doi')} doi from nv where {_D('nv.doi')} is not null and {_D('nv.doi')} not in (select doi from r where doi is not null)",
    "cache_latest": f"with {_LOG} select source, key, event_id, data from cache",
    "cache_three_state": f"with {_LOG}, p as (select c_custkey as key, source from customer, (select distinct source from cache)) select p.source, p.key, case when cache.key is null then 'miss' when data is null then 'negative' when not json_valid(data) then 'miss' else 'hit' end state from p left join cache on cache.key = p.key and cache.source = p.source",
    "cache_purge_negatives": f"with {_LOG} select source, key, event_id from cache where data is not null or source not in ('click', 'view')",
    "cache_fast_path": "with s as (select paper_id, min(rec_id) rec_id from resolved_refs where pdf_path is not null group by 1) select distinct n.paper_id, case when rec_id is not null then 'cached' else 'resolve' end path, rec_id from paper_nodes n left join s on s.paper_id = n.paper_id where n.paper_id is not null",
    "props_values": "select event_id, json_keys(props)[1] field, len(json_keys(props))::int n_fields, json_valid(props) valid from events",
    "breaker_runs": """with e as (select user_id, ts, event_id, event_type = 'error' bad from events), g as (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, bad order by ts, event_id) g from e)
        select user_id, count(*) n_failures, min(event_id) first_event, max(event_id) last_event, count(*) >= 3 opens from g where bad group by user_id, g""",
    "diff_nodes": f"with {NV}, {EV}, {_OLD}, {_DIFF} select id, is_new, unknown_date from dnodes",
    "diff_edges": f"with {NV}, {EV}, {_OLD}, {_DIFF} select src, dst, edge_type, is_new from dedges",
    "diff_counts": f"with {NV}, {EV}, {_OLD}, {_DIFF} select (select count(*) from dnodes where is_new) new_nodes, (select count(*) from dnodes where unknown_date) unknown_dates, (select count(*) from dedges where is_new) new_edges",
    "since_filter": f"with {NV} select id, {_PASS} passes from nv",
    "wrapped_values": "select entry_id, case when entry_id % 5 <> 0 then title end title from bib_entries where title is not null",
    "normalized_records": rf"""select rec_id, case when rec_id % 2 = 1 then 'citation_index' else 'work_index' end kind, title, pub_year as year, publication_date, {_D('doi')} doi, case when rec_id % 2 = 1 then {_A('arxiv_id')} end arxiv_id,
        case when rec_id % 2 = 1 then length(abstract) else length(nullif(trim(regexp_replace(abstract, '\s+', ' ', 'g')), '')) end::int abstract_chars, citation_count,
        coalesce(array_to_string(list_filter(authors, lambda a: coalesce(a, '') <> ''), '; '), '') authors, url from resolved_refs""",
    "embedded_links": """select rec_id, case rec_id % 4 when 0 then 'https://cdn.example.org/file' || rec_id || '.pdf' when 1 then 'https://site.example.org/store/file' || rec_id || '.pdf' when 2 then 'https://x.example.org/file' || rec_id || '.pdf' end link from resolved_refs""",
    "citing_nodes": f"""with x as (select rec_id, pub_year, title raw, {_D('doi')} d, {_A('arxiv_id')} a, {_T('title')} t from resolved_refs)
        select rec_id, coalesce('doi:' || d, 'arxiv:' || a, case when length(raw) > 0 then 'title:' || substr(sha256(t), 1, 16) end, 'unknown:' || substr(sha256('unknown'), 1, 8)) id, pub_year as year,
          coalesce('https://arxiv.org/abs/' || a, 'https://doi.org/' || d) url, coalesce('ARXIV:' || a, 'DOI:' || d) lookup, 'analyzed' status from x where length(trim(coalesce(raw, ''))) > 0 or d is not null or a is not null""",
    "resolve_ids": f"""with dn as (select {_D('doi')} k, min(rec_id) r from resolved_refs where {_D('doi')} is not null group by 1), an as (select {_A('arxiv_id')} k, min(rec_id) r from resolved_refs where {_A('arxiv_id')} is not null group by 1),
        tn as (select {_T('title')} k, min(rec_id) r from resolved_refs where {_T('title')} <> '' group by 1)
        select entry_id, coalesce(dn.r, an.r, tn.r) rec_id, case when dn.r is not null then 'doi' when an.r is not null then 'arxiv' else 'title' end "by" from bib_entries b
        left join dn on dn.k = {_D('b.doi')} left join an on an.k = {_A('b.arxiv_id')} left join tn on tn.k = {_T('b.title')} where coalesce(dn.r, an.r, tn.r) is not null""",
    "title_candidates": f"""with ph as (select entry_id, lower(substr(trim(regexp_replace(regexp_replace(title, '[^A-Za-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200)) p,
          list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{4,}}'), lambda w: w not in ({_STOP}))[1:8] w from bib_entries where title is not null),
        rc as (select rec_id, lower(substr(trim(regexp_replace(regexp_replace(title, '[^A-Za-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200)) p, regexp_extract_all(lower(title), '[a-z0-9]+') ws from resolved_refs where title is not null),
        a as (select entry_id, rec_id, 'phrase' strategy from ph join rc using (p) where p <> '' qualify row_number() over (partition by entry_id order by rec_id) <= 5),
        c as (select entry_id, rec_id, 'words' strategy from ph join rc on len(w) > 0 and list_has_all(ws, w) and rc.p <> '' where ph.p <> '' and entry_id not in (select entry_id from a) qualify row_number() over (partition by entry_id order by rec_id) <= 10)
        select * from a union all select * from c""",
    "latest_version": "select paper_id, greatest(coalesce(max(rec_id % 4), 1), 1)::int as version from resolved_refs group by 1",
}
