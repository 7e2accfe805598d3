"""References to canonical papers: exact and fuzzy joins, cascades over providers, result caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refloom.functions.fuzzy import fuzzy_pairs
from refloom.functions.ids import normalize_arxiv, normalize_doi, normalize_title
from refloom.functions.texts import query_phrase, query_words
from refloom.plans.lineage import cut, release
from refloom.plans.numbering import number_rows
from refloom.plans.skew import HOT_ROWS, lookup_join, salted_join
from refloom.settings import SETTINGS

SEARCH_LEAST, LINK_LEAST, LINK_CHARS, YEARS_APART = SETTINGS.search_least, SETTINGS.link_least, SETTINGS.link_chars, SETTINGS.search_years_apart
#: Sets of words that a word alone may find; a word that more sets have is asked for together with another.
RARE = 200


def truthy(c: Column, kind: str) -> Column:
    """Null for values that count as missing: 0, empty strings and empty arrays."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit(0)) if kind in ("int", "bigint", "double") else c


def exact_links(bib: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entry_id, paper_id, target, bib_key, label, year): entries whose DOI, else arXiv id, names a node.

    An id that several nodes carry belongs to the last of them; a DOI hit on the paper itself ends
    the lookup.
    """
    last = lambda c: nodes.filter(c.isNotNull()).groupBy(c.alias("k")).agg(F.max_by("id", F.struct("added_at", "id")).alias("target"))
    by_doi, by_arxiv = last(normalize_doi(F.col("doi"))), last(normalize_arxiv(F.col("arxiv_id")))
    b = bib.select("entry_id", "paper_id", "bib_key", F.coalesce(truthy(F.col("title"), "string"), "raw", F.lit("")).alias("label"), F.col("pub_year").alias("year"), normalize_doi(F.col("doi")).alias("d"), normalize_arxiv(F.col("arxiv_id")).alias("a"))
    b = b.filter("d is not null or a is not null")
    b = b.join(by_doi.select(F.col("k").alias("d"), F.col("target").alias("td")), "d", "left").join(by_arxiv.select(F.col("k").alias("a"), F.col("target").alias("ta")), "a", "left")
    return b.select("entry_id", "paper_id", F.coalesce("td", "ta").alias("target"), "bib_key", "label", "year").filter("target is not null and target <> paper_id")


def secondary_edges(bib: DataFrame, nodes: DataFrame, primary: DataFrame) -> DataFrame:
    """Links that only bibliographies show: (src, dst, context, depth), one per pair.

    ``bib``: paper_id in one notation; sources are nodes themselves; pairs with a primary edge are left
    out; the context names the first entry.
    """
    known = nodes.select(F.col("id").alias("paper_id"), F.col("depth").alias("d_src"))
    e = exact_links(bib, nodes).join(known, "paper_id")
    e = e.join(primary.select(F.col("src").alias("paper_id"), F.col("dst").alias("target")), ["paper_id", "target"], "left_anti")
    e = e.join(nodes.select(F.col("id").alias("target"), F.col("depth").alias("d_dst")), "target")
    context = F.concat(F.lit("bibliographic link (ref "), "bib_key", F.lit(": "), F.substring("label", 1, 120), F.lit(")"))
    first = e.groupBy(F.col("paper_id").alias("src"), F.col("target").alias("dst")).agg(F.min_by(context, "entry_id").alias("context"), F.max(F.greatest("d_src", "d_dst")).alias("depth"))
    return first


def fuzzy_links(bib: DataFrame, nodes: DataFrame, skip: DataFrame) -> DataFrame:
    """(src, dst, entry_id, score): for each paper and node the best entry by title, 88 or more.

    ``skip``: (src, dst) pairs found otherwise. Scores are computed once per pair of distinct titles.
    """
    b = bib.select("paper_id", "entry_id", normalize_title(F.coalesce(truthy(F.col("title"), "string"), "raw")).alias("a")).filter("a <> ''")
    n = nodes.select(F.col("id").alias("dst"), normalize_title(F.col("title")).alias("b")).filter(F.length("b") >= LINK_CHARS)
    scored = fuzzy_pairs(b, n, LINK_LEAST)
    j = b.join(scored, "a").join(n, "b").filter("paper_id <> dst").select(F.col("paper_id").alias("src"), "dst", "entry_id", "score")
    j = j.join(skip.select("src", "dst"), ["src", "dst"], "left_anti")
    best = j.groupBy("src", "dst").agg(F.max_by(F.struct("entry_id", "score"), F.struct("score", -F.col("entry_id"))).alias("x"))
    return best.select("src", "dst", "x.entry_id", "x.score")


def title_search(bib: DataFrame, candidates: DataFrame, year_rule: str, first_only: bool = False) -> DataFrame:
    """(entry_id, rec_id, score): the best candidate by title, 85 or more.

    ``candidates``: rec_id (its rank), title, pub_year. ``year_rule``: 'before' drops candidates more
    than three years off before ranking, 'after' rejects a winner that is, 'none' ignores years.
    ``first_only`` looks at each title's first candidate alone.
    """
    b = bib.select("entry_id", F.col("pub_year").alias("by"), normalize_title(F.col("title")).alias("a")).filter("a <> ''")
    c = candidates.select("rec_id", F.col("pub_year").alias("cy"), normalize_title(F.col("title")).alias("b")).filter("b <> ''")
    if first_only:
        c = c.groupBy("b").agg(F.min_by(F.struct("rec_id", "cy"), "rec_id").alias("x")).select("b", "x.rec_id", "x.cy")
    off = F.coalesce(F.abs(F.col("by") - F.col("cy")) > YEARS_APART, F.lit(False))
    j = b.join(fuzzy_pairs(b, c, SEARCH_LEAST), "a").join(c, "b")
    if year_rule == "before":
        j = j.filter(~off)
    best = j.groupBy("entry_id").agg(F.max_by(F.struct("rec_id", "score", off.alias("off")), F.struct("score", -F.col("rec_id"))).alias("x"))
    if year_rule == "after":
        best = best.filter("not x.off")
    return best.select("entry_id", "x.rec_id", "x.score")


def coalesce_records(records: DataFrame, key: str, rank: list[Column], fields: list[str]) -> DataFrame:
    """One record per key; each field is the first value, by rank, that does not count as missing."""
    kinds = dict(records.dtypes)
    order = F.struct(*rank)
    aggs = [F.min(F.when(truthy(F.col(f), kinds[f]).isNotNull(), F.struct(order.alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return records.groupBy(key).agg(*aggs)


def location(pdf: Column, supplied: Column, arxiv: Column, openreview: Column, open_access: Column, preprint: Column) -> tuple[Column, Column]:
    """(kind, address) of the first place that has the full text; null if none."""
    parts = (
        ("supplied", supplied),
        ("stored", pdf),
        ("arxiv", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)),
        ("openreview", F.concat(F.lit("https://openreview.net/pdf?id="), openreview)),
        ("open_access", open_access),
        ("preprint", preprint),
    )
    kind = reduce(lambda acc, p: F.when(p[1].isNotNull(), F.lit(p[0])).otherwise(acc), reversed(parts), F.lit(None).cast("string"))
    return kind, F.coalesce(*(p[1] for p in parts))


def enrich(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes with missing abstract, citation count, year and authors filled by DOI; 0 is a count, '' no abstract."""
    r = records.withColumn("d", normalize_doi(F.col("doi"))).filter("d is not null")
    best = r.groupBy("d").agg(F.min_by(F.struct("abstract", "citation_count", "pub_year", "authors"), "rec_id").alias("r"))
    n = nodes.withColumn("d", normalize_doi(F.col("doi"))).join(best, "d", "left")
    return n.select(
        "id", "d",
        F.coalesce(truthy(F.col("abstract"), "string"), "r.abstract").alias("abstract"),
        F.coalesce("citation_count", "r.citation_count").alias("citation_count"),
        F.coalesce(truthy(F.col("year"), "int"), "r.pub_year").alias("year"),
        F.coalesce(truthy(F.col("authors"), "array"), "r.authors").alias("authors"),
        F.col("r").isNotNull().alias("found"),
    )


def chunks(keys: DataFrame, key: str, size: int = SETTINGS.batch_keys) -> DataFrame:
    """Distinct keys with the number of their request, ``size`` keys in each, in order."""
    return number_rows(keys.select(key).filter(F.col(key).isNotNull()).distinct(), key, "_n").select(key, F.floor((F.col("_n") - 1) / size).alias("chunk"))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row written for each key."""
    w = W.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order))
    return log.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def lookup_cache(probes: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Probes with ``state``: hit, negative (known to be absent) or miss; data that is no JSON is a miss."""
    c = cache.select(*keys, "data", F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "miss").when(F.col("data").isNull(), "negative").when(F.try_parse_json("data").isNull(), "miss").otherwise("hit")
    return probes.join(c, keys, "left").withColumn("state", state).drop("_there")


def latest_versions(preprints: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version): the greatest version number of each preprint, 1 where none is a number above it."""
    return preprints.groupBy(key).agg(F.greatest(F.coalesce(F.max(F.col(version).try_cast("int")), F.lit(1)), F.lit(1)).alias("version"))


def breaker(calls: DataFrame, failures: int = SETTINGS.breaker_failures, open_seconds: int = SETTINGS.breaker_open_seconds) -> DataFrame:
    """Calls (source, ts, call, failed) in order of time with ``allowed`` and ``opened``.

    After so many failures in a row the circuit is open for a time: calls in it are not allowed and tell nothing.
    A success closes it. Rows stream through their task in order, with the state of one source at a time.
    """

    schema = ", ".join(f"{c} {t}" for c, t in calls.dtypes) + ", allowed boolean, opened boolean"

    def walk_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            allowed, opened = [], []
            for source, ts, failed in zip(pdf["source"], pdf["ts"], pdf["failed"], strict=True):
                if source not in state:
                    state = {source: (0, None)}  # rows of a source follow each other
                bad, until = state[source]
                ok, now = until is None or ts >= until, False
                if ok:
                    bad, until = (bad + 1, until) if failed else (0, None)
                    if bad >= failures:
                        bad, until, now = 0, ts + pd.Timedelta(seconds=open_seconds), True
                state[source] = bad, until
                allowed.append(ok)
                opened.append(now)
            yield pdf.assign(allowed=allowed, opened=opened)

    return calls.repartition("source").sortWithinPartitions("source", "ts", "call").mapInPandas(walk_part, schema)


def best_entry(bib: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, entry_id, by): for each node the first entry with its DOI, else with its arXiv id, else the entry whose title is most like its own, 88 or more."""
    one = lambda c, k: bib.select("entry_id", c.alias(k)).filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("entry_id").alias(f"e_{k}"))
    n = nodes.select("id", normalize_doi(F.col("doi")).alias("d"), normalize_arxiv(F.col("arxiv_id")).alias("a"), normalize_title(F.col("title")).alias("b"))
    n = n.join(one(normalize_doi(F.col("doi")), "d"), "d", "left").join(one(normalize_arxiv(F.col("arxiv_id")), "a"), "a", "left")
    exact = n.select("id", F.coalesce("e_d", "e_a").alias("entry_id"), F.when(F.col("e_d").isNotNull(), "doi").otherwise("arxiv").alias("by")).filter("entry_id is not null")
    left = n.join(exact.select("id"), "id", "left_anti").filter(F.length("b") >= LINK_CHARS).select("id", "b")
    titles = bib.select("entry_id", normalize_title(F.coalesce(truthy(F.col("title"), "string"), "raw")).alias("a")).filter("a <> ''")
    scored = titles.join(fuzzy_pairs(titles, left, LINK_LEAST), "a").join(left, "b")
    best = scored.groupBy("id").agg(F.max_by("entry_id", F.struct("score", -F.col("entry_id"))).alias("entry_id"))
    return exact.unionByName(best.select("id", "entry_id", F.lit("title").alias("by")))


def title_candidates(bib: DataFrame, records: DataFrame, phrases: int = SETTINGS.phrase_candidates, words: int = SETTINGS.keyword_candidates, rare: int = RARE) -> DataFrame:
    """(entry_id, rec_id, strategy): records to compare an entry's title with.

    The first ``phrases`` records, by id, with the title's whole phrase; for entries without any, the first
    ``words`` records that hold all words of weight in the title. Both limits are those of an index's answer.
    """
    phrase = lambda c: F.lower(query_phrase(c))
    first = lambda df, key, most: df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("rec_id"))).filter(F.col("_k") <= most).drop("_k")
    b = bib.select("entry_id", phrase(F.col("title")).alias("p"), F.array_join(F.array_sort(F.array_distinct(F.split(query_words(F.col("title")), " "))), " ").alias("w")).filter("p <> ''")
    found = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))
    r = records.select("rec_id", phrase(F.col("title")).alias("p"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("words")).filter("p <> ''")
    # A phrase, or a set of words, has so many records in any answer: later ones are left out before the join.
    by_phrase = cut(first(salted_join(b.select("entry_id", "p"), first(r.select("rec_id", "p"), "p", phrases), "p").select("entry_id", "rec_id"), "entry_id", phrases))
    rest = b.join(by_phrase.select("entry_id"), "entry_id", "left_anti").filter("w <> ''").select("entry_id", "w")
    sets = cut(first(r.select("rec_id", "words"), "words", words).groupBy("words").agg(F.collect_list("rec_id").alias("recs")))
    met = cut(first(_holding(rest.select("w").distinct(), sets, rare), "w", words))
    release(bib.sparkSession)
    by_words = first(salted_join(rest, met, "w").select("entry_id", "rec_id"), "entry_id", words)
    return by_phrase.withColumn("strategy", F.lit("phrase")).unionByName(by_words.withColumn("strategy", F.lit("words")))


def _holding(asked: DataFrame, sets: DataFrame, rare: int) -> DataFrame:
    """(w, rec_id): for each ``w`` the records of all ``sets`` with all its words.

    ``w`` and ``words``: distinct words, in order, between blanks. A set is found by its rarest word; where more than
    ``rare`` sets have that one, by the pair of its two rarest, and the other words are checked.
    """
    each = sets.select("words", F.explode(F.split("words", " ")).alias("word"))
    n = cut(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    ranked = lookup_join(asked.select("w", F.explode(F.split("w", " ")).alias("word")), n, "word", "inner")
    ranked = ranked.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o")).filter(F.size("o") == F.size(F.split("w", " ")))  # else no set has all words
    two = F.array_join(F.array_sort(F.slice(F.col("o")["word"], 1, 2)), " ")
    often = F.col("o")[0]["n"] > rare
    ranked = cut(ranked.select("w", F.when(often, two).otherwise(F.col("o")[0]["word"]).alias("key")))
    of_words = lookup_join(each, n.filter(F.col("n") <= rare), "word", "inner").withColumnRenamed("word", "key").join(sets, "words")
    frequent = lookup_join(each, n.filter(F.col("n") > rare), "word", "inner").groupBy("words").agg(F.array_sort(F.collect_list("word")).alias("f")).join(sets, "words")
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.concat(x, F.lit(" "), y))))
    keyed = of_words.select("words", "recs", "key").unionByName(frequent.select("words", "recs", F.explode(F.concat("f", pairs)).alias("key")))
    padded = F.concat(F.lit(" "), "words", F.lit(" "))
    may_be_hot = (n.agg(F.max("n")).first()[0] or 0) > HOT_ROWS  # no key is in more sets than its word
    release(asked.sparkSession)
    met = salted_join(ranked, keyed, "key", hot_sides=(True, may_be_hot))
    return met.filter(F.forall(F.split("w", " "), lambda x: F.contains(padded, F.concat(F.lit(" "), x, F.lit(" "))))).select("w", F.explode("recs").alias("rec_id"))


def encoded_texts(texts: DataFrame, key: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(key, embedding) of (key, text): ``load`` gives a function from texts to vectors and is called once a task; null texts have no vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            yield pd.DataFrame({key: pdf[key], "embedding": encode(pdf["text"].tolist()) if len(pdf) else []})

    return texts.select(key, "text").mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<double>")
