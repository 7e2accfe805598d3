"""Page furniture and words broken across lines in text read from page images.

Defined cases
- null, empty and blank text: no spot. One page only: a number counts as a page number if a running
  head stands beside it, or if it is written as one (- 9 -, p. 9, Page 3 of 10).
- a number on a line of its own that belongs to no run of page numbers is text (tables, years).
- a word broken at the end of the last line stays as it is.
- a hyphen that belongs to the word itself (self-supervised) is no break; the vocabulary decides.
"""

from __future__ import annotations

import re
import unicodedata

from refloom.llm.canonical import _Table
from refloom.llm.names import edit

HYPHENS = "-­‐¬"
_NUMBER = re.compile(r"^\s*(?:[-–—~•·|]\s*(\d{1,5})\s*[-–—~•·|]|p(?:p|age)?\.?\s*(\d{1,5})(?:\s*(?:of|/)\s*\d{1,5})?|Page\s+(\d{1,5})(?:\s+of\s+\d{1,5})?|(\d{1,5}))\s*$", re.I)
_TRAIL = re.compile(r"^(.*\S)(?:\s{2,}|\t|\s+[|–—-]\s+)(\d{1,5})\s*$")
_LEAD = re.compile(r"^\s*(\d{1,5})(?:\s{2,}|\t|\s+[|–—-]\s+)(\S.*)$")
_SHAPES = str.maketrans("015α", "olsa")
_ISSUE = re.compile(r"(?:,?\s*(?:vol|no|nr|issue)\.?\s*\d+|\s*\(\d{4}\)|,\s*\d{4})+\s*$", re.I)
_AND_OTHERS = re.compile(r"^(\S+(?: \S+){0,2}) ([ec]t al|\S{2,4} \S{5,7})\.?$")
_SERIALS = ("journal", "annals", "transactions", "proceedings", "archives", "advances", "bulletin")
_STOP = re.compile(r"[.!?:;,)\]”»\"]$")
HEAD_LENGTH = 24


_SHOWN = _Table(lambda c: None if unicodedata.category(c) in ("Mn", "Cf", "Cc") else c)


def plain(s: str) -> str:
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
    return " ".join(s.casefold().translate(_SHOWN).split())


def _alike(a: str, b: str, most: int) -> bool:
    """Equal but for at most ``most`` misread places (same length but for merged or split shapes)."""
    return edit(a, b, most) <= most


def _serial(p: str) -> bool:
    """The name of a serial, be it misread."""
    w = p.split()
    return len(w) > 2 and len(p) < 100 and w[1] in ("of", "on", "in", "0f", "0n", "for") and any(_alike(w[0].translate(_SHAPES), x, 2) for x in _SERIALS)


def _by_author(p: str, words: set[str]) -> bool:
    """An author of the paper and others, be it misread."""
    m = _AND_OTHERS.match(p.translate(_SHAPES))
    if not m or not (m[2] in ("et al", "ct al") or _alike(m[2], "and others", 2)):
        return False
    return any(w in words or any(len(w) > 4 and _alike(w, x, 2) for x in words) for w in re.findall(r"[^\W\d_]+", m[1]))


def furniture(lines: list[str], title: str | None, authors: list[str] | None) -> dict[int, str]:
    """line_no -> running_head or page_number."""
    names = {max((w for w in re.findall(r"[^\W\d_]+", plain(a or "")) if len(w) > 2), key=len, default="") for a in authors or []}
    words = {w for a in authors or [] for w in re.findall(r"[^\W\d_]+", plain(a or "")) if len(w) > 3} | (names - {""})
    full = plain(re.sub(r"<[^>]+>", "", title)) if title else ""
    numbers: dict[int, int] = {}  # bare number lines
    styled: set[int] = set()
    heads: dict[int, int | None] = {}  # certain heads, with their number
    maybe: dict[int, int | None] = {}  # head-like lines with a number, or repeated
    seen: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        s = line.strip("\x0c \t ")
        if not s:
            continue
        if m := _NUMBER.match(s):
            numbers[i] = int(next(g for g in m.groups() if g))
            if not s.isdigit():
                styled.add(i)
            continue
        number, core = None, s
        if m := _TRAIL.match(s):
            core, number = m[1], int(m[2])
        elif m := _LEAD.match(s):
            core, number = m[2], int(m[1])
        p = plain(_ISSUE.sub("", core)) or plain(core)
        if _serial(p) and not re.search(r"[.!?:;,)\]”»]$", _ISSUE.sub("", core)):
            heads[i] = number
        elif full and len(p) >= min(HEAD_LENGTH, len(full)) and len(p) <= len(full) + 2 and _alike(p, full[: len(p)], 2 + len(p) // 24) and (number is not None or len(p) < len(full) or len(lines) > 1):
            heads[i] = number
        elif _by_author(p, words):
            heads[i] = number
        elif number is not None and len(core) < 90 and not _STOP.search(core):
            maybe[i] = number
        if len(p) >= 8 and not _STOP.search(core.rstrip(".")):
            seen.setdefault(p, []).append(i)
    # Runs of page numbers: every next page one more.
    values = sorted([(i, v) for i, v in numbers.items()] + [(i, v) for i, v in {**maybe, **heads}.items() if v is not None])
    run: set[int] = set()
    for k, (i, v) in enumerate(values):
        if any(v - w == sign * d for sign, part in ((1, values[max(0, k - 4) : k][::-1]), (-1, values[k + 1 : k + 5])) for d, (_, w) in enumerate(part, 1) if d == 1 or abs(v - w) == 1):
            run.add(i)
        elif any(abs(v - w) == 1 for _, w in values[max(0, k - 4) : k] + values[k + 1 : k + 5]):
            run.add(i)

    def beside(i: int, those: dict | set) -> bool:
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(lines) and not lines[j].strip("\x0c \t "):
                j += step
            if j in those:
                return True
        return False

    out: dict[int, str] = dict.fromkeys(heads, "running_head")
    for i in numbers:
        if i in styled or i in run or (beside(i, heads) and numbers[i] < 3000):
            out[i] = "page_number"
    for i in maybe:
        if i in run:
            out[i] = "running_head"
    pages = {i for i, k in out.items() if k == "page_number"}
    for p, at in seen.items():
        if len(at) > 1 and len(p.split()) > 1 and sum(beside(i, pages) for i in at) > 1:
            for i in at:
                out.setdefault(i, "running_head")
    return out


def breaks(lines: list[str], skip: dict[int, str]) -> list[tuple[int, int, str, str, str]]:
    """(line_no, line of the rest, first part, hyphen, rest) of every word that a line end may have broken."""
    out = []
    for i, line in enumerate(lines):
        if i in skip:
            continue
        last = line.rstrip(" \t")
        if len(last) < 2 or last[-1] not in HYPHENS or not last[-2:-1].isalpha():
            continue
        j = i + 1
        while j < len(lines) and (j in skip or not lines[j].strip("\x0c \t ")):
            j += 1
        if j == len(lines):
            continue
        rest = re.match(r"\s*(\S+)", lines[j])
        if rest and rest[1][0].isalpha():
            out.append((i, j, last.rsplit(None, 1)[-1][:-1], last[-1], rest[1]))
    return out


def trim(token: str) -> str:
    """A token in lower case without outer punctuation and citation marks."""
    t = re.sub(r"\[[\d,\s–-]*\]?.*$", "", token)
    return re.sub(r"^[\W_]+|[\W_]+$", "", t).lower()
