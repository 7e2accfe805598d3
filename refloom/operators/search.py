"""All mentions of keywords in texts: by pattern, by meaning, with their windows.

Patterns use Unicode word classes. Texts without any mention are dropped before a Python worker sees
them; offsets are code points of the text.

Defined cases
- null and empty texts: no mention. Empty keyword: ValueError. Repeated rows: each gives its mentions.
- two mentions in one sentence: two rows with one passage. Mentions never overlap within a keyword.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refloom.functions.texts import squash, tiles
from refloom.operators.matching import build_pattern, keyword_body
from refloom.settings import SETTINGS

SENTENCE, CHARACTERS = "sentence", "characters"


def mention_spans(text: str | None, keywords: list[str]) -> list[tuple[int, int, int]]:
    """(kw_no, start, end) of every mention, by keyword and position."""
    return [(no, *m.span()) for no, k in enumerate(keywords) for m in _compiled(k).finditer(text or "")]


def _compiled(keyword: str) -> re.Pattern:
    return re.compile(r"(?<!\w)" + keyword_body(keyword, r"\w"), re.IGNORECASE)


def mentions(texts: DataFrame, key: str, keywords: list[str]) -> DataFrame:
    """(key, text, kw_no, start_pos, end_pos) of every mention in ``texts`` (key, text)."""
    some = F.lit(False)
    for k in keywords:
        some = some | F.col("text").rlike(build_pattern(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            spans: list[tuple[int, int, int]] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = mention_spans(t, keywords)
                at += [i] * len(found)
                spans += found
            cols = list(zip(*spans, strict=True)) or [()] * 3
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, pa.int32()) for c in cols)], names=[key, "text", "kw_no", "start_pos", "end_pos"])

    kind = dict(texts.dtypes)[key]
    return texts.filter(some).select(key, "text").mapInArrow(run, f"{key} {kind}, text string, kw_no int, start_pos int, end_pos int")


def sentences(texts: DataFrame, key: str) -> DataFrame:
    """(key, sent_no, sent_start, sent_end, piece, win_end, nxt) of the tiles of every text; the window runs to the end of the next tile."""
    rows = texts.select(key, tiles(F.col("text")).alias("pieces")).select(key, "pieces", F.posexplode("pieces").alias("sent_no", "piece"))
    start = F.aggregate(F.slice("pieces", F.lit(1), F.col("sent_no")), F.lit(0), lambda acc, x: acc + F.length(x))
    nxt = F.coalesce(F.get("pieces", F.col("sent_no") + 1), F.lit(""))
    rows = rows.select(key, "sent_no", start.alias("sent_start"), "piece", nxt.alias("nxt"))
    end = F.col("sent_start") + F.length("piece")
    return rows.select(key, "sent_no", "sent_start", end.alias("sent_end"), "piece", (end + F.length("nxt")).alias("win_end"), "nxt")


def _located(found: DataFrame) -> DataFrame:
    """Mentions with ``sent_no``, window and passage: the tile that holds their first letter, and the next."""
    pieces = tiles(F.col("text"))
    rows = found.withColumn("pieces", pieces)
    ends = F.transform("pieces", lambda _, i: F.aggregate(F.slice("pieces", F.lit(1), i + 1), F.lit(0), lambda acc, x: acc + F.length(x)))
    rows = rows.withColumn("ends", ends).withColumn("sent_no", F.size(F.filter("ends", lambda e: e <= F.col("start_pos"))))
    first = F.when(F.col("sent_no") > 0, F.get("ends", F.col("sent_no") - 1)).otherwise(0)
    last = F.coalesce(F.get("ends", F.col("sent_no") + 1), F.get("ends", F.col("sent_no")))
    rows = rows.withColumns({"win_start": first, "win_end": last})
    return rows.drop("pieces", "ends")


def windows(found: DataFrame, mode: str = SENTENCE, around: int = 0) -> DataFrame:
    """Mentions with ``sent_no`` (null for characters), ``win_start``, ``win_end`` and ``passage``.

    ``sentence``: the sentence of the mention and the next one; ``characters``: so many on both sides.
    """
    if mode == SENTENCE:
        rows = _located(found)
    else:
        rows = found.withColumns({"sent_no": F.lit(None).cast("int"), "win_start": F.greatest(F.lit(0), F.col("start_pos") - around), "win_end": F.least(F.length("text"), F.col("end_pos") + around)})
    return rows.withColumn("passage", squash(F.substr("text", F.col("win_start") + 1, F.col("win_end") - F.col("win_start")))).drop("text")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def by_meaning(sents: DataFrame, key: str, matched: DataFrame, vectors: DataFrame, queries: DataFrame, least: float = SETTINGS.semantic_least, chars: int = SETTINGS.semantic_chars) -> DataFrame:
    """(key, kw_no, sent_no, sent_start, sent_end, win_end, passage, score) of sentences near a keyword's vector.

    ``sents``: see :func:`sentences`; ``matched``: (key, kw_no, sent_no) that a pattern hit, left out for that
    keyword; ``vectors``: (key, sent_no, embedding); ``queries``: (kw_no, query), a row per keyword. Sentences of
    fewer than ``chars`` letters are left out.
    """
    long_ = sents.filter(F.length(F.trim("piece")) >= chars)
    rows = long_.join(vectors, [key, "sent_no"]).join(F.broadcast(queries))  # a row per keyword
    rows = rows.join(matched.select(key, "kw_no", "sent_no").distinct(), [key, "kw_no", "sent_no"], "left_anti")
    scored = rows.withColumn("score", dot(F.col("embedding"), F.col("query"))).filter(F.col("score") >= least)
    return scored.select(key, "kw_no", "sent_no", "sent_start", "sent_end", "win_end", squash(F.concat("piece", "nxt")).alias("passage"), "score")


def search(texts: DataFrame, key: str, keywords: list[str], mode: str = SENTENCE, around: int = 0, vectors: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(key, kw_no, match_type, start_pos, end_pos, win_start, win_end, passage, score): mentions by pattern, then by meaning.

    The pass by meaning needs vectors and sentence mode; its offsets are the sentence's.
    """
    found = windows(mentions(texts, key, keywords), mode, around)
    out = found.select(key, "kw_no", F.lit("regex").alias("match_type"), "start_pos", "end_pos", "win_start", "win_end", "passage", F.lit(None).cast("double").alias("score"))
    if vectors is None or queries is None or mode != SENTENCE:
        return out
    near = by_meaning(sentences(texts, key), key, found, vectors, queries)
    return out.unionByName(near.select(key, "kw_no", F.lit("semantic").alias("match_type"), F.col("sent_start").alias("start_pos"), F.col("sent_end").alias("end_pos"), F.col("sent_start").alias("win_start"), "win_end", "passage", "score"))


def numbered_hits(hits: DataFrame, key: str) -> DataFrame:
    """Hits with ``hit_no`` per text: by keyword, pattern before meaning, position."""
    w = W.partitionBy(key).orderBy("kw_no", "match_type", "start_pos")
    return hits.withColumn("hit_no", F.row_number().over(w))
