"""What two bibliographic descriptions are compared by: forms of the title, and names.

Defined cases
- null or blank title: the title is read from the raw string; without either there is no form.
- kinds of papers (parts, comments, corrections, editions) are a form of their own, so they never mix.
- null or empty authors: no names. Titles of any length: all words count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import xxhash

from refloom.llm.canonical import _KEY, _NUMBER, _TIGHT_NUMBER, _Table, _carve, _pieces, fold, letters

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
# Shapes that scanners and readers take for each other, longer first.
CONFUSED = (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("α", "a"), ("0", "o"), ("5", "s"), ("1", "l"), ("tb", "th"), ("ℓ", "l"))
STOP = frozenset("a an and the of in on for to by with from w at".split())
_KIND = (
    ("comment", re.compile(r"^(?:a )?(?:comments?|reply|response|rejoinder|discussion) (?:on|to)\b")),
    ("correction", re.compile(r"^(?:correction|corrigendum|erratum|addendum|retraction)\b(?: (?:to|notice))?|\b(?:erratum|corrigendum)$")),
)
_PART = re.compile(r"\b(?:part|pt|volume|vol)\.?\s+([ivx]+|\d+)\b")
_EDITION = re.compile(r"\b(\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|revised|extended|abridged|new)\s+(?:ed|edn|edition|version)\b")
_AGAIN = re.compile(r"\b(?:revisited|reconsidered|reloaded|continued|extended abstract|a sequel|sequel)$")
_PARTICLES = frozenset("van von de la der den di da del al dr prof jr sr et the mc and".split())


_BARE = _Table(lambda c: None if unicodedata.category(c) in ("Mn", "Cf") else c)


def plain(s: str) -> str:
    """Lower case ASCII where it can be, tags and accents gone."""
    s = _TAG.sub("", s).casefold()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s).casefold().translate(_BARE)
        for a, b in (("ø", "o"), ("ł", "l"), ("đ", "d"), ("æ", "ae"), ("œ", "oe"), ("ð", "d")):
            s = s.replace(a, b)
    return s.replace("&amp;", "and").replace("&", " and ").replace("w/", "with ")


def title_of_raw(raw: str | None, authors: list[str] | None) -> str | None:
    """The title in a raw reference: its title field, or the longest stretch that is no venue."""
    if not raw or not raw.strip():
        return None
    s = fold(raw)
    keys = list(_KEY.finditer(s))
    for m, nxt in zip(keys, [*keys[1:], None], strict=False):
        if m[1] == "title":
            return s[m.end() : nxt.start() if nxt else len(s)].strip(" {}\",;|")
    wanted = letters("".join(fold(a or "") for a in authors or []))
    segments, _ = _carve([s], wanted)
    dashed = "|" not in s and len(re.findall(r"(?<=\S)\s-\s(?=\S)", s)) > 1
    number = _TIGHT_NUMBER if dashed else _NUMBER
    tight = number.sub("#", " ".join(segments))
    flat = [a or b for a, b in re.findall(r"#\)?\s?([.,;])|([.,;]) \(?#", tight)]
    sep = r"\|" if "|" in s else r"(?:^|\s)-(?:\s|$)" if dashed else r"[%s](?:\s|$)" % re.escape(max(sorted(set(flat)), key=flat.count)) if flat else r"[.,;](?:\s|$)"
    best = ""
    for seg in segments:
        for stretch in number.split(seg):
            for p in _pieces(stretch, sep):
                if not re.match(r"\W*(?:journal of|j\.|transactions on|trans\.|annals of|ann\.|proceedings of|proc\.)", p) and len(p) > len(best):
                    best = p
    return best.strip(" .,;|-\"'“”") or None


@lru_cache(1 << 16)
def _word(s: str) -> str:
    """:func:`_skeleton` of a word; words repeat."""
    return _skeleton(s)


def _skeleton(s: str) -> str:
    for a, b in CONFUSED:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


def title_forms(title: str) -> dict | None:
    """Forms of a title: kind, whole (squeezed), core (without a name before the colon, shapes merged) and its
    words, main and tail (before and after the colon), skeleton (the whole with shapes merged)."""
    s = plain(title)
    s = re.sub(r"-\s+|-(\w)-\s+", lambda m: m[1] or "", s)
    flat = " ".join(re.sub(r"[^\w\s:]+", " ", s).split())
    kind = next((k for k, p in _KIND if p.search(flat.replace(":", " "))), "")
    if m := _PART.search(flat):
        kind += "p" + m[1].replace("l", "i")
    if m := _EDITION.search(flat):
        kind += "e" + m[1]
    if _AGAIN.search(flat):
        kind += "r"
    base = flat
    if kind.startswith(("comment", "correction")):
        base = re.sub(r"^(?:a )?\w+(?: (?:on|to|notice))?\s*:?\s*", "", base)
    words = [w for w in re.sub(r"[:_]", " ", base).split() if w not in STOP]
    whole = re.sub(r"[\W_]+", "", base)
    if not whole:
        return None
    head, colon, rest = base.partition(":")
    name = bool(colon) and len(head.split()) == 1 and len(rest.split()) > 2
    core = rest if name else base
    core_words = [_word(w) for w in re.sub(r"[:_]", " ", core).split() if w not in STOP]
    n_tail = len([w for w in core.rpartition(":")[2].split() if w not in STOP])
    main = core.rpartition(":")[0] if ":" in core else ""
    return {
        "kind": kind, "whole": whole, "core": "".join(core_words), "words": core_words, "main": _skeleton(re.sub(r"[\W_]+", "", main)) if len(main.split()) > 3 else "",
        "tail": "".join(core_words[-n_tail:]) if n_tail >= 4 else "", "skeleton": _skeleton(whole),
    }


def name_tokens(authors: list[str] | None) -> list[str]:
    """Names of two letters and more, shapes merged, particles left out.

    Two capitals beside a name in mixed case are initials (Wu LB), no name.
    """
    out: set[str] = set()
    for a in authors or []:
        mixed = a != (a or "").upper()
        initials = {m.casefold() for m in re.findall(r"(?<!\w)[A-Z]{2}(?!\w)", a or "")} if mixed else set()
        for w in re.split(r"[^\w]+", plain(a or "")):
            w = re.sub(r"[\d_]+", "", w)
            if len(w) > 1 and w not in _PARTICLES and w not in initials:
                out.add(_word(w))
    return sorted(out)


def described(title: str | None, authors: list[str] | None, raw: str | None) -> dict | None:
    """What the rules compare: kind, whole, core, main, tail and skeleton of the title, its words, the names."""
    title = title if title and title.strip() else title_of_raw(raw, authors)
    f = title_forms(title) if title else None
    return f | {"names": name_tokens(authors)} | dict(zip(("words", "again"), numbered(f["words"]), strict=True)) if f else None


def numbered(words: list[str]) -> tuple[list[int], list[int]]:
    """Hashes of the words, those that come again told apart, and hashes of all words that come more than once."""
    n = Counter(words)
    seen: Counter[str] = Counter()
    out, again = [], []
    for w in words:
        h = xxhash.xxh64_intdigest(w, seen[w]) - (1 << 63)
        seen[w] += 1
        out.append(h)
        if n[w] > 1:
            again.append(h)
    return out, again
