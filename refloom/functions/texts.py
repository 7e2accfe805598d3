"""Small text transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Pieces that tile a text: everything up to and with a run of terminators.
TILE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
#: Letters that appear in formulas, hardly in prose; fixed values.
MATH = "[\U0001d400-\U0001d7ffℂℍℕℙℚℝℤ∈∉∋∀∃∅⊂⊃⊆⊇⊕⊗]"
#: Words without weight in search queries; fixed values.
STOPWORDS = ("the", "and", "for", "with", "from", "into", "over", "under", "this", "that", "these", "those", "their", "there", "where", "which", "what", "when", "while", "using", "based", "via", "novel", "towards", "toward", "against")
#: Colours of keywords, in display order; fixed values.
COLORS = ("#fff3a0", "#c5e3a5", "#ffc9b9", "#b9d9ff", "#e0c2ff", "#ffdd99")


def squash(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tiles(c: Column) -> Column:
    """Array of pieces that concatenate back to the text."""
    return F.regexp_extract_all(c, F.lit(TILE), F.lit(0))


def math_chars(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MATH))


def short_label(title: Column, year: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("(untitled)")))
    t = F.when(F.length(t) > 50, F.concat(F.substring(t, 1, 49), F.lit("…"))).otherwise(t)
    return F.concat(t, F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")))


def query_words(title: Column, most: int = 8, least: int = 4) -> Column:
    """First words of a title that carry weight, joined by blanks."""
    words = F.regexp_extract_all(F.lower(title), F.lit(rf"[a-z0-9]{{{least},}}"), F.lit(0))
    return F.array_join(F.slice(F.filter(words, lambda w: ~w.isin(list(STOPWORDS))), 1, most), " ")


def query_phrase(title: Column) -> Column:
    return F.substring(squash(F.regexp_replace(title, r"[^A-Za-z0-9\s-]", " ")), 1, 200)


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_"), 1, 100)


def escape_xml(c: Column) -> Column:
    """Safe in content and in quoted attributes."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def mask(c: Column) -> Column:
    """First four characters, stars for the rest."""
    return F.when(F.length(c) <= 4, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.substring(c, 1, 4), F.repeat(F.lit("*"), F.length(c) - 4)))


def from_inverted_index(index: Column) -> Column:
    """Text of a map word -> positions, words in order of position."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def fnv1a(ids: Column) -> Column:
    """32-bit FNV-1a of the sorted ids joined by '|', as eight hex digits."""
    s = F.array_join(F.sort_array(ids), "|")
    step = lambda h, ch: ((h.bitwiseXOR(F.ascii(ch).cast("bigint"))) * F.lit(16777619)) % F.lit(4294967296)
    h = F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), F.lit(2166136261).cast("bigint"), step)
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def keyword_color(no: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in COLORS)), (no % len(COLORS) + 1).cast("int"))
