"""Matching records of two tables that share no key, by a cascade of exact joins.

Every record is read once into forms of its title and its names. Passes go from strict to weak
attribute combinations; each joins the entries still open with the papers on the keys of that pass,
takes for every entry the strictest rule that holds, and leaves the rest to the next pass. Both sides
are shuffled: no side is broadcast, as estimates of its size do not see the rows that keys add. Within a
rule fewer missing words win, then more names in common, then the nearer year, then the smaller id.

Titles that lack words meet on anchors: words are put in order of their frequency among the papers
(counted by hash in a table of fixed size), rarest first. If at most m words lack on either side and
three are shared, the first m+3 words of both share three, so the triples of those words are keys
that lose no pair; their number is 4 or 10 for a title of any length.

Confidence of a rule is its precision on labelled records, with one right and one wrong case added.
The labels are papers that are described more than once: one description is held out as an entry of
known paper, and the cascade looks for it among all others. Where it was the only one, any match is wrong.

Defined cases
- entry without title and raw, paper without id or title: never matched.
- papers described by several records: any of the descriptions may hit; a paper counts once.
- an entry that hits several papers by title alone (rules 11 and 15): not matched.
- nulls in any column, repeated rows, extra columns: as above or without effect; empty tables give
  an empty result. A work cited by a third of all entries: its keys are salted. A title that very
  many papers share (Editorial) is split by name and year, which its rules demand anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refloom.llm.match_keys import described
from refloom.plans.lineage import cut, release
from refloom.plans.skew import HOT_ROWS, salted_join

#: Words that two titles share at least where words lack.
SHARED = 3
#: Places of the table of word frequencies; two words in one place only change the order of anchors.
PLACES = 1 << 16
#: Papers of one title beyond which its key is split by name and year.
GENERIC = 1_000
#: Edits of one slip at most: a swap of neighbours that makes one of the merged shapes and pushes out the last letter.
SLIP = 3
#: Rules that demand neither a name nor a year: an entry that hits several papers by them stays open.
BY_TITLE = (11, 15)
#: Held-out descriptions at most, for the precision of rules.
LABELS = 20_000

_TEXT = ("kind", "whole", "core", "main", "tail", "skeleton")
_FORMS = ", ".join(f"{c} string" for c in _TEXT) + ", words array<bigint>, again array<bigint>, names array<string>"


def _reader(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*(pa.string() for _ in _TEXT), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        for b in batches:
            rows = []
            for i, title, authors, year, raw in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if f := described(title, authors, raw):
                    rows.append((i, year, *(f[c] for c in (*_TEXT, "words", "again", "names"))))
            cols = list(zip(*rows, strict=True)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, pa.int32(), *types], strict=True)], names=["id", "year", *_TEXT, "words", "again", "names"])

    return run


def read_forms(records: DataFrame, id_type: str) -> DataFrame:
    """Forms of every record with a title; ``records``: id, title, authors, year, raw."""
    kind = pa.int64() if id_type == "bigint" else pa.string()
    cols = [F.col("id"), "title", "authors", F.col("year").cast("int").alias("year"), "raw"]
    return cut(records.filter("id is not null").select(*cols).mapInArrow(_reader(kind), f"id {id_type}, year int, {_FORMS}"))


def _hash(*cols: str | Column) -> Column:
    return F.xxhash64(*cols)


def word_counts(papers: DataFrame) -> list[int]:
    """How often words of titles occur among papers, by hash in ``PLACES`` places."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[int, int] = {}
            for words in b.column(0).to_pylist():
                for w in set(words):
                    p = w % PLACES
                    n[p] = n.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["place", "n"])

    out = [0] * PLACES
    for r in papers.select("words").mapInArrow(place, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most PLACES rows
        out[r["place"]] = r["n"]
    return out


def anchored(forms: DataFrame, lacking: int, counts: list[int], id_type: str) -> DataFrame:
    """``forms`` with ``key``: one row per triple of the rarest words. Titles of fewer than four words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            keys: list[int] = []
            for i, (k, words) in enumerate(zip(b.column("kind").to_pylist(), b.column("words").to_pylist(), strict=True)):
                if len(words) < SHARED + 1:
                    continue
                hashed = sorted((counts[h % PLACES], h) for h in words)[: lacking + SHARED]
                for three in combinations([h for _, h in hashed], SHARED):
                    at.append(i)
                    keys.append(xxhash.xxh64_intdigest(repr((k, three))) - (1 << 63))
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.int64())], names=[*rows.schema.names, "key"])

    slim = forms.select("id", "year", "kind", "words", "again", "names")
    return slim.mapInArrow(run, f"id {id_type}, year int, kind string, words array<bigint>, again array<bigint>, names array<string>, key bigint")


def _paper(df: DataFrame) -> DataFrame:
    return df.select("key", *(F.col(c).alias(f"p_{c}") for c in df.columns if c != "key"))


def _named() -> Column:
    return F.arrays_overlap("names", "p_names")


def _dated() -> Column:
    return F.coalesce(F.col("year") == F.col("p_year"), F.lit(False))


@dataclass(frozen=True)
class Limits:
    """Sizes at which keys are split, and how many rows of either side a key can have at most."""

    hot_rows: int = HOT_ROWS
    generic: int = GENERIC
    entries: int = 1 << 62
    papers: int = 1 << 62

    def join(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Salted join; a side with fewer rows than make a key hot need not be counted. A row has a key twice at most."""
        return salted_join(left, _paper(right), "key", self.hot_rows, hot_sides=(2 * self.entries > self.hot_rows, 2 * self.papers > self.hot_rows), hint="merge")


def _met(left: DataFrame, right: DataFrame, at: Limits) -> DataFrame:
    """Pairs that share ``key`` and a name or the year; keys of very many papers are split by name and year first."""
    if 2 * at.papers <= at.generic:
        return at.join(left, right).filter(_named() | _dated())
    crowded = right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > at.generic).select("key")
    crowded = cut(crowded).hint("merge")
    if crowded.isEmpty():
        return at.join(left, right).filter(_named() | _dated())
    cold = at.join(left.join(crowded, "key", "left_anti"), right.join(crowded, "key", "left_anti")).filter(_named() | _dated())
    parts = F.explode(F.array_union(F.col("names"), F.array_compact(F.array(F.concat(F.lit("#"), F.col("year").cast("string"))))))
    fine = lambda df: df.join(crowded, "key", "left_semi").withColumn("part", parts).withColumn("key", _hash("key", "part")).drop("part")
    return cold.unionByName(at.join(fine(left), fine(right)))


def _keys(forms: DataFrame, *keys: tuple[int, Column]) -> DataFrame:
    """One row per key that is there; ``slot`` tells forms of titles apart."""
    each = F.array_compact(F.array(*(F.when(k.isNotNull(), F.struct(F.lit(s).alias("slot"), k.alias("k"))) for s, k in keys)))
    return forms.withColumn("_k", F.explode(F.array_distinct(each))).withColumn("slot", F.col("_k.slot")).withColumn("key", _hash("_k.slot", "kind", "_k.k")).drop("_k")


def _if(c: str, least: int = 1) -> Column:
    return F.when(F.length(c) >= least, F.col(c))


def _slim(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "year", "kind", "names", *more)


def _pass_whole(e: DataFrame, p: DataFrame, at: Limits) -> DataFrame:
    """Rules 0 to 5: the whole title, or its core, with a name and the year, a name, or the year."""
    keyed = lambda df: _keys(_slim(df, "whole", "core"), (0, _if("whole", 8)), (3, _if("core", 8))).drop("whole", "core", "kind")
    j = _met(keyed(e), keyed(p), at)
    return j.withColumn("rule", F.col("slot") + F.when(_named() & _dated(), 0).when(_named(), 1).otherwise(2)).withColumn("lack", F.lit(0))


def _lacking() -> Column:
    """The greater number of words that either title has alone; null if the shared words stand in another order.

    Words that come more than once have no part in the order: any one of them may lack.
    """
    once = lambda w: ~F.array_contains("again", w) & ~F.array_contains("p_again", w)
    mine = F.filter("words", lambda w: ~F.array_contains("p_words", w))
    theirs = F.filter("p_words", lambda w: ~F.array_contains("words", w))
    ordered = F.filter("words", lambda w: F.array_contains("p_words", w) & once(w)) == F.filter("p_words", lambda w: F.array_contains("words", w) & once(w))
    return F.when(ordered, F.greatest(F.size(mine), F.size(theirs)))


def _pass_lacking(e: DataFrame, p: DataFrame, lacking: int, counts: list[int], at: Limits) -> DataFrame:
    """Rules 6 and 7 (one word lacks; a name, or the year) or 9 (two words; a name)."""
    j = _met(anchored(e, lacking, counts, "bigint"), anchored(p, lacking, counts, "string"), at).withColumn("lack", _lacking())
    short = F.least(F.size("words"), F.size("p_words"))
    if lacking == 1:
        return j.filter("lack <= 1").withColumn("rule", F.when(_named(), 6).otherwise(7))
    long_ = F.greatest(F.size("words"), F.size("p_words"))
    return j.filter(_named() & (F.col("lack") <= 2) & (short >= 4) & (long_ >= 6)).withColumn("rule", F.lit(9))


def _pass_parts(e: DataFrame, p: DataFrame, at: Limits) -> DataFrame:
    """Rule 8: one title is what stands before the colon in the other; with a name."""
    keyed = lambda df: _keys(_slim(df, "main", "core"), (0, _if("main")), (0, F.col("core"))).drop("main", "core", "kind")
    return _met(keyed(e), keyed(p), at).filter(_named()).withColumn("rule", F.lit(8)).withColumn("lack", F.lit(0))


def _pass_cut(e: DataFrame, p: DataFrame, at: Limits) -> DataFrame:
    """Rule 12: one title begins the other but for a slip; with a name, and the year too if only 24 letters are sure. Rule 13: the tail after a colon."""
    keyed = lambda df: _keys(_slim(df, "whole", "tail", "skeleton"), (12, F.left("whole", F.lit(24))), (13, _if("tail"))).drop("tail", "kind")
    by_name = lambda df: keyed(df).filter((F.col("slot") == 13) | (F.length("whole") >= 24)).withColumn("name", F.explode("names")).withColumn("key", _hash("key", "name")).drop("name")
    j = at.join(by_name(e), by_name(p))
    a, b = F.col("skeleton"), F.col("p_skeleton")
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    begins = F.levenshtein(short, F.left(long_, F.length(short)), SLIP) >= 0
    sure = _dated() | (F.left("whole", F.lit(34)) == F.left("p_whole", F.lit(34))) & (F.least(F.length("whole"), F.length("p_whole")) >= 34)
    return j.filter((F.col("slot") == 13) | (begins & sure)).withColumn("rule", F.col("slot")).withColumn("lack", F.lit(0))


def _pass_title(e: DataFrame, p: DataFrame, at: Limits) -> DataFrame:
    """Rules 10, 11, 15 (one side has no authors: year near, whole title, core) and 14 (names agree at their beginning or end)."""
    ends = lambda n: F.array_union(F.transform("names", lambda x: F.concat(F.lit("^"), F.left(x, F.lit(n)))), F.transform("names", lambda x: F.concat(F.right(x, F.lit(n)), F.lit("$"))))
    full = lambda df: _slim(df, "whole", "core", "words").withColumns({"ends": ends(4), "n_words": F.size("words")}).drop("words")
    keyed = lambda df: _keys(full(df), (0, _if("core")), (1, _if("whole"))).drop("core", "kind")
    j = at.join(keyed(e), keyed(p))
    lone = (F.size("names") == 0) | (F.size("p_names") == 0)
    same_core, near = F.col("slot") == 0, F.abs(F.col("year") - F.col("p_year")) <= 1
    rule = F.when(same_core & lone & near, 10).when(~same_core & lone, 11).when(same_core & F.arrays_overlap("ends", "p_ends"), 14).when(same_core & lone & (F.col("n_words") >= 5), 15)
    return j.withColumn("rule", rule).filter("rule is not null").withColumn("lack", F.lit(0))


def _pairs(j: DataFrame) -> DataFrame:
    """One row per entry, paper and rule."""
    return j.groupBy("id", F.col("p_id").alias("paper_id"), "rule").agg(
        F.min("lack").alias("lack"), F.max(F.size(F.array_intersect("names", "p_names"))).alias("n"), F.min(F.abs(F.col("year") - F.col("p_year"))).alias("apart")
    )


def match_forms(entries: DataFrame, papers: DataFrame, hot_rows: int = HOT_ROWS, generic: int = GENERIC) -> DataFrame:
    """(id, paper_id, rule, apart) from the forms of both sides."""
    counts, n_papers = word_counts(papers), papers.count()
    passes = (
        lambda e, at: [_pass_whole(e, papers, at)],
        lambda e, at: [_pass_lacking(e, papers, 1, counts, at), _pass_parts(e, papers, at)],
        lambda e, at: [_pass_lacking(e, papers, 2, counts, at), _pass_cut(e, papers, at)],
        lambda e, at: [_pass_title(e, papers, at)],
    )
    spark, open_, n_open, found = entries.sparkSession, entries, entries.count(), []
    del entries  # the forms of entries that are matched go with their pass
    for run in passes:
        at = Limits(hot_rows, generic, n_open, n_papers)
        hits = reduce(DataFrame.unionByName, (_pairs(j) for j in run(open_, at)))
        if run is passes[-1]:
            one = hits.groupBy("id", "rule").agg(F.count(F.lit(1)).alias("papers")).filter((F.col("papers") == 1) | ~F.col("rule").isin(*BY_TITLE)).select("id", "rule")
            hits = hits.join(one.hint("merge"), ["id", "rule"], "left_semi")
        w = W.partitionBy("id").orderBy("rule", "lack", F.col("n").desc(), F.col("apart").asc_nulls_last(), "paper_id")
        best = cut(hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "paper_id", "rule", "apart"))
        found.append(best)
        n_open -= best.count()
        if run is not passes[-1]:
            open_ = cut(open_.join(best.select("id").hint("merge"), "id", "left_anti"))
        del hits
        release(spark)  # else what the passes shuffled piles up on disk
    return reduce(DataFrame.unionByName, found)


def cascade(entries: DataFrame, papers: DataFrame, **limits: int) -> DataFrame:
    """(id, paper_id, rule, apart). ``entries``: id bigint; ``papers``: id string; both: title, authors, year, raw."""
    return match_forms(read_forms(entries, "bigint"), read_forms(papers, "string"), **limits)


def rule_precision(papers: DataFrame, labels: int = LABELS) -> DataFrame:
    """(rule, n_labelled, confidence) from the papers' forms.

    Of each labelled paper (about ``labels`` at most, picked by hash of their ids) one description is
    held out, in order of its hash, and matched against all that is left.
    """
    share = max(1, -(-papers.select("id").distinct().count() // labels))
    rows = papers.withColumn("_h", F.xxhash64("id", "whole", "names", "year"))
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("label"), "id"), F.lit(share)) == 0).groupBy("id").agg(F.min("_h").alias("_h"))
    held = cut(rows.join(picked, ["id", "_h"], "left_semi").dropDuplicates(["_h"]))
    rest = rows.join(held.select("_h"), "_h", "left_anti").drop("_h")
    found = match_forms(held.withColumn("id", F.col("_h")).drop("_h"), rest)
    j = found.join(held.select(F.col("_h").alias("id"), F.col("id").alias("true_paper")), "id")
    right = F.count_if(F.col("paper_id") == F.col("true_paper"))
    return j.groupBy("rule").agg(F.count(F.lit(1)).alias("n_labelled"), ((right + 1) / (F.count(F.lit(1)) + 2)).alias("confidence"))
