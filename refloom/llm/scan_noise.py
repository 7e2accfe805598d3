"""Noise in text read from page images: furniture, broken words, misread words.

Words of the whole corpus are counted by origin. Each word has an anagram value, the sum of the fifth
powers of its code points (modulo a prime), so that one misread shape changes it by a known difference.
Words that are rare and stand in no structured text join the frequent words at these differences; the
pairs that one substitution really turns into each other are ranked by frequency, and the first is the
correction. Pages are then read once: furniture, words broken at line ends, and the words that may have
a correction (by a filter of fixed size) leave that pass. Broken words are joined if the joined form is
better known than the form with its hyphen; all the forms that are to be known are looked up in one join.

Defined cases
- null, empty and blank texts give no spot. Words of one letter are not corrected; shapes that scanners
  confuse are Latin and Greek ones, words of any script may hold them.
- equally frequent corrections: the smaller word. A word that stands in structured text is corrected
  only if the other is fifty times as frequent.
- papers repeated under one id: each different text gives its spots, a text delivered again none anew.
- an empty table gives an empty result. Extra columns are ignored.
- a word that makes up a third of all tokens: counted map-side, looked up through salted keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refloom.llm.pages import breaks, furniture, trim
from refloom.llm.prefixes import BITS, Filter
from refloom.plans.lineage import cut
from refloom.plans.skew import lookup_join

#: What is right, and what scanners make of it; fixed values.
CONFUSIONS = (("e", "c"), ("o", "0"), ("s", "5"), ("l", "1"), ("a", "α"), ("d", "cl"), ("u", "ii"), ("h", "b"), ("m", "rn"), ("t", "f"), ("in", "m"), ("li", "h"), ("ri", "n"), ("w", "vv"), ("i", "1"), ("b", "6"), ("g", "9"), ("z", "2"), ("o", "ο"), ("ni", "m"), ("nn", "m"), ("h", "li"), ("n", "ri"))
WORD = r"[\p{L}\p{N}]+"


#: Code points are taken modulo this, so that sums of fifth powers stay whole numbers of 64 bits.
PRIME = (1 << 31) - 1
_PIECE = re.compile(r"[^\W_]+")


def anagram_value(word: str) -> int:
    return sum(pow(ord(c), 5, PRIME) for c in word)


def _value(word: Column) -> Column:
    square = lambda x: x * x % PRIME
    fifth = lambda x: square(square(x)) * x % PRIME
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, x: acc + fifth(F.ascii(x).cast("bigint")))


def vocabulary(papers: DataFrame) -> DataFrame:
    """(word, clean, scan): occurrences in structured and in scanned text, words broken at a line end left out.

    Compounds with one inner hyphen are counted as words too.
    """
    text = F.regexp_replace(F.lower("text"), r"(?<!\S)\S+[-­‐¬][ \t]*\n\s*\S*", " ")
    words = F.concat(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\p{L}+-\p{L}+"), F.lit(0)))
    rows = papers.filter("text is not null").select(F.coalesce(F.col("text_origin") == "scan", F.lit(False)).alias("is_scan"), F.explode(words).alias("word"))
    return rows.groupBy("word").agg(F.count_if(~F.col("is_scan")).alias("clean"), F.count_if("is_scan").alias("scan"))


def corrections(words: DataFrame) -> DataFrame:
    """(word, fixed): the best frequent variant of each rare confusable word."""
    plain = words.filter((F.length("word") > 1) & ~F.col("word").contains("-") & F.col("word").rlike(r"\p{L}"))
    valued = cut(plain.select("word", "clean", "scan", _value(F.col("word")).alias("av")))
    shifts = F.array(*(F.struct(F.lit(anagram_value(r) - anagram_value(m)).alias("shift"), F.lit(r).alias("right"), F.lit(m).alias("wrong")) for r, m in CONFUSIONS))
    rare = valued.filter("scan > 0").select("word", "clean", "scan", "av", F.explode(shifts).alias("c")).filter(F.instr("word", F.col("c.wrong")) > 0)
    rare = rare.select("word", "clean", "scan", (F.col("av") + F.col("c.shift")).alias("target"), "c.right", "c.wrong")
    cand = valued.select(F.col("word").alias("fixed"), (F.col("clean") + F.col("scan")).alias("n"), F.col("av").alias("target"))
    j = rare.join(cand, "target").filter((F.col("n") >= 5 * F.col("scan")) & (F.col("n") >= 50 * F.col("clean")) & (F.col("n") > 2))
    turned = F.exists(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: (F.substr("word", i, F.length("wrong")) == F.col("wrong")) & (F.concat(F.substr("word", F.lit(1), i - 1), F.col("right"), F.substr("word", i + F.length("wrong"))) == F.col("fixed")),
    )
    w = W.partitionBy("word").orderBy(F.col("n").desc(), "fixed")
    return j.filter(turned).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("word", "fixed")


_SPOTS = {"row": pa.int64(), "paper_id": pa.string(), "line_no": pa.int32(), "kind": pa.string(), "part": pa.string(), "hyphen": pa.string(), "rest": pa.string(), "rest_line": pa.int32()}
_SPOTS_DDL = "row bigint, paper_id string, line_no int, kind string, part string, hyphen string, rest string, rest_line int"


def _read_pages(wanted: Filter):
    """Spots of every paper in one pass; of kind ``token`` are tokens with a piece that may have a correction (in ``rest``).

    Lines of furniture and the parts of broken words give no token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, paper, text, title, authors in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not text or not text.strip():
                    continue
                lines = text.split("\n")
                gone = furniture(lines, title, authors)
                out += [(row, paper, i, k, None, None, None, None) for i, k in sorted(gone.items())]
                broken = breaks(lines, gone)
                out += [(row, paper, i, "split_word", a, h, r, j) for i, j, a, h, r in broken]
                lasts, firsts = {i for i, *_ in broken}, {j for _, j, *_ in broken}
                for i, line in enumerate(lines):
                    if i in gone:
                        continue
                    tokens = line.split()
                    for t in tokens[1 if i in firsts else 0 : -1 if i in lasts else None]:
                        for piece in set(_PIECE.findall(t.lower())):
                            at = crc32(piece.encode("utf-8", "surrogatepass")) % BITS
                            if wanted.bits[at >> 3] >> (at & 7) & 1 and piece in _PIECE.findall(trim(t)):
                                out.append((row, paper, i, "token", t, None, piece, None))
            cols = list(zip(*out, strict=True)) or [()] * len(_SPOTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SPOTS.values(), strict=True)], names=list(_SPOTS))

    return run


def noise_spots(papers: DataFrame) -> DataFrame:
    """(row, paper_id, line_no, noise_kind, fixed_word, raw, rest_line) of every spot in scanned papers.

    ``papers``: paper_id, text, title, authors, text_origin. ``row`` tells different texts of one id apart.
    """
    words = cut(vocabulary(papers))
    fixes = cut(corrections(words))
    wanted = Filter.of(fixes.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BITS)).cast("int").alias("place")))
    scans = papers.filter("text_origin = 'scan'").select(F.xxhash64("paper_id", "text").alias("row"), "paper_id", "text", "title", "authors").dropDuplicates(["row"])
    spots = cut(scans.mapInArrow(_read_pages(wanted), _SPOTS_DDL))
    lines = spots.filter("kind not in ('split_word', 'token')").select("row", "paper_id", "line_no", F.col("kind").alias("noise_kind"), F.lit("").alias("fixed_word"), F.lit(None).cast("string").alias("raw"), F.col("rest_line"))
    known = words.join(fixes, "word", "left")
    return lines.unionByName(_broken(spots.filter("kind = 'split_word'"), known)).unionByName(_misread(spots.filter("kind = 'token'"), fixes))


def _broken(spots: DataFrame, known: DataFrame) -> DataFrame:
    """Broken words by what is known (word, clean, scan, fixed) of their joined form, their compound and their parts."""
    last, first = F.regexp_extract(F.lower("part"), r"(\p{L}+)$", 1), F.regexp_extract(F.lower("rest"), r"^(\p{L}+)", 1)
    s = spots.withColumns({"a": last, "b": first}).withColumns({"joined": F.concat("a", "b"), "compound": F.concat_ws("-", "a", "b")})
    forms = ("joined", "compound", "a", "b")
    asked = s.select("joined", "compound", "a", "b", F.explode(F.array(*(F.struct(F.lit(x).alias("form"), F.col(x).alias("word")) for x in forms))).alias("x")).select("a", "b", "joined", "compound", "x.form", "x.word").distinct()
    facts = lookup_join(cut(asked), known, "word", "inner")
    pick = lambda form, c: F.max(F.when(F.col("form") == form, c))
    n = F.col("clean") + F.col("scan")
    facts = facts.groupBy("a", "b").agg(*(pick(x, n).alias(f"n_{x}") for x in forms), *(pick(x, F.col("clean")).alias(f"c_{x}") for x in ("a", "b")), pick("joined", F.col("fixed")).alias("joined_fixed"))
    s = s.join(facts, ["a", "b"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    better = z("n_joined") > z("n_compound")
    own_hyphen = (F.col("hyphen") == "-") & ~better & ((z("n_compound") > 0) | ((z("c_a") > 0) & (z("c_b") > 0) & (z("n_joined") == 0)))
    whole = F.concat(F.regexp_replace("part", r"\p{L}+$", ""), F.coalesce("joined_fixed", "joined"), F.regexp_replace("rest", r"^\p{L}+", ""))
    token = F.lower(F.regexp_replace(F.regexp_replace(whole, r"\[[\d,\s–-]*\]?.*$", ""), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return s.filter(~own_hyphen).select("row", "paper_id", "line_no", F.lit("split_word").alias("noise_kind"), token.alias("fixed_word"), F.col("part").alias("raw"), "rest_line")


def _misread(tokens: DataFrame, fixes: DataFrame) -> DataFrame:
    hit = lookup_join(tokens.select("row", "paper_id", "line_no", F.col("part").alias("raw"), F.col("rest").alias("word")), fixes, "word", "inner")

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("raw", "word", "fixed")]
            right = [_PIECE.sub(lambda m, w=w, f=f: f if m[0] == w else m[0], trim(raw)) for raw, w, f in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "paper_id", "line_no")), pa.array(["misread_word"] * len(right), pa.string()), pa.array(right, pa.string()), b.column("raw"), pa.nulls(len(right), pa.int32())], names=["row", "paper_id", "line_no", "noise_kind", "fixed_word", "raw", "rest_line"])

    return hit.mapInArrow(fix, "row bigint, paper_id string, line_no int, noise_kind string, fixed_word string, raw string, rest_line int")


def repaired(papers: DataFrame) -> DataFrame:
    """(row, paper_id, text): scanned papers as paragraphs without furniture, words whole and corrected."""
    spots = noise_spots(papers).groupBy("row").agg(F.collect_list(F.struct("line_no", "noise_kind", "fixed_word", "raw", "rest_line")).alias("spots"))
    scans = papers.filter("text_origin = 'scan'").select(F.xxhash64("paper_id", "text").alias("row"), "paper_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [repair(t, s) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string())], names=["row", "paper_id", "text"])

    # The spots of one paper are bounded by its own length.
    return scans.join(spots, "row", "left").select("row", "paper_id", "text", "spots").mapInArrow(run, "row bigint, paper_id string, text string")


def repair(text: str | None, spots: list[dict] | None) -> str | None:
    """Apply the spots of one paper."""
    if text is None:
        return None
    lines, by = text.split("\n"), {}
    for s in spots or []:
        by.setdefault(s["line_no"], []).append(s)
    gone = {i for i, v in by.items() if any(s["noise_kind"] in ("running_head", "page_number") for s in v)}
    for i, v in by.items():
        for s in v:
            if s["noise_kind"] != "misread_word":
                continue
            wrong, right = s["raw"], s["fixed_word"]
            core = trim(wrong)
            at = wrong.lower().find(core)
            if at >= 0:
                new = right.capitalize() if wrong[at : at + 1].isupper() else right
                lines[i] = lines[i].replace(wrong, wrong[:at] + new + wrong[at + len(core) :], 1)
    carried: dict[int, str] = {}
    for i in sorted(by):
        for s in by[i]:
            if s["noise_kind"] == "split_word" and s["rest_line"] is not None:
                rest = re.match(r"\s*(\S+)\s?", lines[s["rest_line"]])
                if rest:
                    lines[i] = re.sub(r"\S[ \t]*$", "", lines[i].rstrip()) + rest[1]
                    lines[s["rest_line"]] = lines[s["rest_line"]][rest.end() :]
                    carried[s["rest_line"]] = rest[1]
    out: list[list[str]] = [[]]
    for i, line in enumerate(lines):
        s = line.strip("\x0c \t ")
        if i in gone or (not s and i in carried):
            continue
        if not s:
            rest = next((x for k, x in enumerate(lines[i + 1 :], i + 1) if k not in gone and x.strip()), "")
            inside = out[-1] and not re.search(r"[.!?:。！？।؟”»\"\])]$", out[-1][-1]) and any(k in gone for k in (i - 2, i - 1, i + 1, i + 2)) and rest.lstrip()[:1].islower()
            if out[-1] and not inside:
                out.append([])
            continue
        if re.match(r"^[  ]{2,}\S", line) and out[-1] and re.search(r"[.!?:。！？।؟”»\"\])]$", out[-1][-1]):
            out.append([])
        out[-1].append(s)
    return "\n\n".join(" ".join(" ".join(p).split()) for p in out if p)
