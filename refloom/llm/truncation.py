"""Texts that were cut before their end.

Every text asks about its end: is its last unit, last line, last word or the whole text a strict prefix of
a longer one elsewhere, does it stand somewhere as a whole, and does what follows its last but one word
elsewhere go on beyond its last one? The prefix join answers for all texts at once from the units, lines,
words and pairs of words that stand in all texts. What the text ends in decides which answers count:

- a text whose last unit is a strict prefix of a longer one, and nowhere a whole unit, was cut there; so
  was a text that ends in a list item, label, link, formula, heading or line of code and that a longer text
  continues in that line, unless that line stands as a whole somewhere;
- a unit without terminator was cut if a longer one, or its last two words elsewhere, go on after it; if no
  copy of its end stands anywhere, the missing terminator alone decides;
- an abbreviation's stop ends no sentence; an ellipsis or a title does only after a whole word;
- in scripts without terminators the last letters must be ones that end units elsewhere.

``evidence`` names what decided: unit, pair, word, line or copy (the join), mark (a note that the text goes
on) or ending (no copy stands).

Defined cases
- null, empty and blank texts: not cut. Repeated texts: each row is judged, all alike.
- null source: reported as a source of its own (null). Texts of any length are read whole.
- an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from refloom.llm.endings import ending, is_open_word, split_mark
from refloom.llm.prefixes import STANDING, Filter, answered, asked_whole, goes_on, key_rows, prefix_key, standing_keys, whole_keys
from refloom.llm.sentences import sentence_spans
from refloom.plans.lineage import cut
from refloom.plans.skew import lookup_join

#: Letters at the end of a unit that are compared in scripts without terminators: about a final particle with the syllable before it.
SUFFIX = 6
#: Kinds of endings that need no terminator: only a longer copy of the text tells that they were cut.
IN_LINE = ("list", "label", "link", "formula", "code", "heading", "line")
#: Stands after the last word of a unit.
LAST = "\x1e"
_WORD = re.compile(r"[^\W\d_]+")
_ELLIPSIS = re.compile(r"\s*(?:\.\.\.|…)$")
_CITES = re.compile(r"(?<=[.!?।॥؟。！？”»\"」])(?:\s?\[\d[\d,\s–-]*\])+$")
_BREAKS = re.compile(r"[ \t]+(?=\n)")
_SPACELESS = re.compile(r"[฀-໿က-႟ក-៿]")


def _bare(unit: str) -> str:
    return _ELLIPSIS.sub("", _CITES.sub("", unit))


def last_parts(text: str | None) -> dict | None:
    """What the judgement of a text rests on; None for a blank text."""
    if text is None or not text.strip():
        return None
    s, mark = split_mark(text)
    kind, _ = ending(s)
    spans = sentence_spans(s)
    unit = s[spans[-1][0] : spans[-1][1]] if spans else s.strip()
    dots = bool(_ELLIPSIS.search(s))
    unit = _ELLIPSIS.sub("", unit) if dots else _CITES.sub("", unit)
    words = _WORD.findall(unit)
    asks: list[tuple[str, tuple[int, str, int]]] = []
    if unit:
        asks += [("unit", prefix_key("u", unit)), ("unit_whole", asked_whole("u", unit))]
    if words and unit.endswith(words[-1]) and (dots or kind in ("title", "spaceless", "line", "open")):
        w = words[-1].lower()
        asks += [("word", prefix_key("w", w)), ("word_whole", asked_whole("w", w))]
    line = re.split(r"[\n\r]+", s.strip())[-1].strip()
    if kind in IN_LINE:
        asks += [("line_whole", asked_whole("l", line)), ("copy", prefix_key("c", _BREAKS.sub("", s)))]
    if kind == "spaceless":
        asks.append(("tail_whole", asked_whole("s", s[-SUFFIX:])))
    tokens = unit.split()
    if kind in ("open", "abbreviation") and len(tokens) > 1:
        asks.append(("pair", prefix_key("p" + tokens[-2] + "\x1f", tokens[-1])))
    return {
        "kind": kind, "mark": mark, "dots": dots, "open_word": is_open_word(s.split()[-1]), "copy": _BREAKS.sub("", s),
        "units": [_bare(text[a:b]) for a, b in spans[:-1]], "last": unit, "asks": [{"fact": f, "key": k, "rest": r, "place": p} for f, (k, r, p) in asks],
    }


_ASK = pa.struct([("fact", pa.string()), ("key", pa.int64()), ("rest", pa.string()), ("place", pa.int32())])
_PARTS = (("kind", pa.string()), ("mark", pa.bool_()), ("dots", pa.bool_()), ("open_word", pa.bool_()), ("copy", pa.string()), ("units", pa.list_(pa.string())), ("last", pa.string()), ("asks", pa.list_(_ASK)))
_BLANK = {"kind": "blank", "mark": False, "dots": False, "open_word": False, "copy": None, "units": [], "last": None, "asks": []}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [last_parts(t) or _BLANK for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([p[k] for p in parts], t) for k, t in _PARTS)], names=["id", *(k for k, _ in _PARTS)])


def _standing(wanted: Filter):
    """Keys of all that stands in a batch of texts, as far as anyone asks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units: set[str] = set()
            lasts: set[str] = set()  # may be cut, so they stand for longer copies only
            pairs: set[tuple[str, str]] = set()
            words: set[str] = set()
            out: set[tuple[int, str]] = set()
            for copy, own, last in zip(*(b.column(c).to_pylist() for c in ("copy", "units", "last")), strict=True):
                if copy is None:
                    continue
                out.update(standing_keys("c", copy, wanted))
                for line in re.split(r"[\n\r]+", copy.strip())[:-1]:
                    out.update(whole_keys("l", line.strip(), wanted))
                units.update(own)
                lasts.add(last)
            for u in units:
                tokens = u.split()
                if tokens:
                    tokens[-1] += LAST
                    pairs.update(zip(tokens, tokens[1:], strict=False))
                    words.update(tokens)
                if u and (_SPACELESS.match(u[-1]) or u[-1] == "%"):
                    out.update(whole_keys("s", u[-SUFFIX:], wanted))
            for u in lasts:
                tokens = u.split()[:-1]
                pairs.update(zip(tokens, tokens[1:], strict=False))
                out.update(standing_keys("u", u, wanted))
            for kind, values in (("u", units), ("w", {w.lower() for t in words for w in _WORD.findall(t)})):
                for v in values:
                    out.update(whole_keys(kind, v, wanted))
                    out.update(standing_keys(kind, v, wanted))
            for a, after in pairs:
                out.update(standing_keys("p" + a + "\x1f", after, wanted))
            yield key_rows(out)

    return run


def facts_of(parts: DataFrame) -> DataFrame:
    """(row, fact) of every answer that is yes."""
    asks = parts.select("row", F.explode("asks").alias("a")).select("row", F.col("a.fact").alias("kind"), "a.key", "a.rest", "a.place")
    wanted = Filter.of(asks)
    nxt = F.substr("stretch", F.length("rest") + 1, F.lit(1))
    here = F.col("stretch").startswith(F.col("rest"))
    # A pair goes on if its second word does, or if more follows the word in its unit.
    pair = here & ((nxt == "") | nxt.rlike(r"[\p{L}\p{N},;:/–-]"))
    yes = F.when(F.col("kind").endswith("_whole"), True).when(F.col("kind") == "pair", pair).when(F.col("kind") == "copy", goes_on() & ~nxt.isin("\n", "\r")).otherwise(goes_on())
    facts = answered(asks, parts.select("copy", "units", "last").mapInArrow(_standing(wanted), STANDING), {"yes": yes}).filter("yes")
    same = F.xxhash64("kind", "key", "rest").alias("fact_id")
    return lookup_join(cut(asks.select("row", "kind", same)), facts.select(same).distinct(), "fact_id", "inner").select("row", F.col("kind").alias("fact"))


def judged(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, kind, is_cut, evidence) of every row."""
    schema = "id bigint, kind string, mark boolean, dots boolean, open_word boolean, copy string, units array<string>, last string, asks array<struct<fact: string, key: bigint, rest: string, place: int>>"
    # Rows of one id are told apart by their text.
    parts = cut(texts.select("id", "text").mapInArrow(_parts, schema).withColumn("row", F.xxhash64("id", "copy")))
    facts = facts_of(parts).groupBy("row").agg(F.collect_set("fact").alias("facts"))  # at most one of each kind
    rows = parts.select("id", "row", "kind", "mark", "dots", "open_word").join(facts, "row", "left")
    return rows.select("id", "kind", evidence().alias("evidence")).select("id", "kind", F.col("evidence").isNotNull().alias("is_cut"), "evidence")


def evidence() -> Column:
    """What shows that a text was cut, over the columns that :func:`judged` gathers; null if it was not."""
    has = lambda f: F.coalesce(F.array_contains("facts", F.lit(f)), F.lit(False))
    longer, broken = has("unit") & ~has("unit_whole"), has("word") & ~has("word_whole")
    copied, new_line = has("copy") & ~has("line_whole"), ~has("line_whole")
    mark, open_word, kind = F.col("mark"), F.col("open_word"), F.col("kind")
    joined = F.when(longer, "unit").when(broken, "word")
    in_line = F.when(copied, "copy")
    return (
        F.when(kind.isin("open", "abbreviation"), F.when(longer, "unit").when(has("pair"), "pair").when(broken, "word").when(mark, "mark").when((kind == "abbreviation") | ~has("unit_whole"), "ending"))
        .when(kind == "stop", F.when(longer, "unit").when(F.col("dots"), F.when(broken, "word").when(open_word, "ending")))
        .when(kind == "title", F.coalesce(joined, F.when(mark, "mark").when(open_word, "ending")))
        .when(kind == "spaceless", F.when(longer, "unit").when(mark, "mark").when(~has("tail_whole"), "ending"))
        .when(kind == "line", F.when(new_line, F.when(longer, "unit").otherwise(F.coalesce(in_line, F.lit("ending")))))
        .when(kind == "code", F.coalesce(in_line, F.when(mark, "mark")))
        .when(kind == "heading", F.when(new_line, F.coalesce(in_line, F.when(mark, "mark"))))
        .when(kind != "blank", in_line)
    )
