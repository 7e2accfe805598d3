"""Passages that mention a keyword, and the references beside them.

A keyword becomes a pattern: its words may be joined by a blank or hyphen or nothing, the last word,
if longer than four letters, loses two and takes any ending. Sentences are tiles of the text, so all
offsets are sums of piece lengths; everything up to the references is narrow, one pass per text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refloom.functions.texts import squash, tiles
from refloom.settings import SETTINGS

STEM_FROM = SETTINGS.stem_from


def keyword_body(keyword: str, word: str) -> str:
    """A keyword's words joined by a blank, a hyphen or nothing, the last one stemmed; empty keywords raise ValueError."""
    tokens = [t for t in re.split(r"[\s-]+", keyword.strip()) if t]
    if not tokens:
        raise ValueError("empty keyword")
    last = tokens[-1]
    parts = [re.escape(t) for t in tokens[:-1]] + [re.escape(last[: -SETTINGS.stem_drops]) + word + "*" if len(last) >= STEM_FROM else re.escape(last)]
    return r"[\s-]?".join(parts)


def build_pattern(keyword: str) -> str:
    """Pattern with Unicode word classes; empty keywords raise ValueError."""
    return r"(?iuU)(?<!\w)" + keyword_body(keyword, r"\w")


def mentioned(text: Column, keywords: list[str]) -> Column:
    """Array of (kw_no, keyword) that a text mentions; the patterns are constants, compiled once."""
    found = [F.when(text.rlike(build_pattern(k)), F.struct(F.lit(i).alias("kw_no"), F.lit(k).alias("keyword"))) for i, k in enumerate(keywords)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def sentence_hits(texts: DataFrame, key: str, keywords: list[str]) -> DataFrame:
    """(key, kw_no, keyword, sent_no, start_pos, end_pos, win_end, passage) of every sentence that mentions a keyword.

    The window runs to the end of the next sentence. Texts without any hit are dropped before they
    are cut into sentences.
    """
    some = F.lit(False)
    for k in keywords:
        some = some | F.col("text").rlike(build_pattern(k))
    rows = texts.filter(some).select(key, tiles(F.col("text")).alias("pieces")).select(key, "pieces", F.posexplode("pieces").alias("sent_no", "piece"))
    rows = rows.select("*", F.explode(mentioned(F.col("piece"), keywords)).alias("k"))
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("sent_no")), F.lit(0), lambda acc, x: acc + F.length(x))
    nxt = F.coalesce(F.get("pieces", F.col("sent_no") + 1), F.lit(""))
    rows = rows.select(key, "k.kw_no", "k.keyword", "sent_no", before.alias("start_pos"), "piece", nxt.alias("nxt"))
    end = F.col("start_pos") + F.length("piece")
    return rows.select(key, "kw_no", "keyword", "sent_no", "start_pos", end.alias("end_pos"), (end + F.length("nxt")).alias("win_end"), squash(F.concat("piece", "nxt")).alias("passage"))


def refs_in_windows(hits: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Hits with the keys of the references whose whole span lies in their window, in order of first span."""
    j = hits.join(refs.select(key, "bib_key", "ref_start", "ref_end"), key).filter((F.col("ref_start") >= F.col("start_pos")) & (F.col("ref_end") <= F.col("win_end")))
    first = j.groupBy(key, "kw_no", "keyword", "sent_no", "bib_key").agg(F.min("ref_start").alias("at"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("at", "bib_key"))), lambda x: x["bib_key"])
    return first.groupBy(key, "kw_no", "keyword", "sent_no").agg(F.array_join(keys, " ").alias("ref_keys"), F.count(F.lit(1)).alias("n_refs"))


def match_mode(texts: DataFrame, key: str, keywords: list[str]) -> DataFrame:
    """(key, n_keywords, n_hits, matches_any, matches_all) of texts that mention a keyword."""
    counts = [F.regexp_count("text", F.lit(build_pattern(k))) for k in keywords]
    out = texts.select(key, F.array(*counts).alias("c"))
    n = F.size(F.filter("c", lambda x: x > 0))
    return out.select(key, n.alias("n_keywords"), F.aggregate("c", F.lit(0), lambda a, x: a + x).alias("n_hits"), (n > 0).alias("matches_any"), (n == len(keywords)).alias("matches_all")).filter("matches_any")


def first_seen_keys(hits: DataFrame, key: str) -> DataFrame:
    """(key, bib_key, passage): reference keys of a text's hits with the first passage that has each.

    ``hits``: key, hit_id (the order), passage, ref_keys array.
    """
    rows = hits.select(key, "hit_id", "passage", F.posexplode("ref_keys").alias("pos", "bib_key"))
    return rows.groupBy(key, "bib_key").agg(F.min_by("passage", F.struct("hit_id", "pos")).alias("passage"), F.min(F.struct("hit_id", "pos")).alias("_o")).select(key, "bib_key", "passage", F.col("_o.hit_id").alias("first_hit_id"))


def credited_contexts(contexts: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds ``kw_no``: the first keyword that a context mentions, null if none."""
    out = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(keywords))):
        out = F.when(F.col("context").rlike(build_pattern(k)), F.lit(i)).otherwise(out)
    return contexts.withColumn("kw_no", out)


def dot(a: Column, vector: list[float]) -> Column:
    return F.aggregate(F.zip_with(a, F.array(*(F.lit(float(x)) for x in vector)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def references_of(refs: DataFrame, bib: DataFrame) -> DataFrame:
    """Inline references joined with the entry of their paper and key; a key parsed twice keeps its later entry."""
    last = W.partitionBy("paper_id", "bib_key").orderBy(F.col("entry_id").desc())
    one = bib.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    return refs.join(one, ["paper_id", "bib_key"])
