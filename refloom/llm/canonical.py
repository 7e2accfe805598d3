"""Canonical bytes of a bibliographic record: what is left when formatting is ignored.

White space, letter case and punctuation go; the fields of the raw string are told apart, whatever
style it is written in, and put in a fixed order, while the order of words within a field stays.
Volume and issue are one field, so are the two ends of a page range.

Defined cases
- raw null, empty or blank: no canonical form (None); such records are no copies of each other.
- null title: a title of its own, equal only to another null title.
- a raw string whose style is not recognised is cut at its separators; nothing is dropped.
"""

from __future__ import annotations

import re
import unicodedata

#: Names that mark a field in keyed styles; fixed values.
KEYS = "author|title|journal|booktitle|volume|number|issue|pages|year|doi|publisher|url|note|month|editor|eprint"
_KEY = re.compile(rf"(?:(?<=[\s,;|{{.])|^)({KEYS})\s*[=:]\s*(?=\S)")
_DASH = "-‐‑‒–—―−"
_NUMBER = re.compile(rf"(?<![^\W_])(?:\d+\s*[{_DASH}]+\s*\d+|\d+\s*[:/]\s*\d+|\d+\s*\(\s*\d+\s*\)|\d+)(?![^\W_])")
_TIGHT_NUMBER = re.compile(rf"(?<![^\W_])(?:\d+(?:[{_DASH}]+|\s*(?:[{_DASH[1:]}]|--)\s*)\d+|\d+\s*[:/]\s*\d+|\d+\s*\(\s*\d+\s*\)|\d+)(?![^\W_])")
_VENUE = re.compile(r"^\W*(?:journal of|j\b|transactions on|trans\b|annals of|ann\b|proceedings of|proc\b)", re.UNICODE)


class _Table(dict):
    """Translation table that is filled as code points are met."""

    def __init__(self, change) -> None:
        self.change = change

    def __missing__(self, code: int) -> str | int | None:
        self[code] = out = self.change(chr(code))
        return out


def fold(s: str) -> str:
    """Compatible characters, lower case, no invisible characters, single blanks."""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s).casefold().translate(_VISIBLE)
    return " ".join(s.casefold().split())


def _kept(ch: str) -> bool:
    return ch.isalnum() or unicodedata.category(ch)[0] == "M"


_VISIBLE = _Table(lambda ch: None if unicodedata.category(ch) == "Cf" else ch)
_LETTERS = _Table(lambda ch: ch if _kept(ch) else None)
_GAPS = _Table(lambda ch: ch if _kept(ch) else "\x00")
_APART = re.compile(r"(?<=\d)\x00+(?=\d)")


def letters(s: str) -> str:
    """Letters and digits of a string."""
    return s.translate(_LETTERS)


def squeeze(s: str) -> str:
    """Letters and digits only; digits that were apart stay apart."""
    return _APART.sub("-", s.translate(_GAPS)).replace("\x00", "")


def _carve(segments: list[str], wanted: str) -> tuple[list[str], bool]:
    """Take the stretch whose letters and digits are ``wanted`` out of one of the segments."""
    if not wanted:
        return segments, False
    for k, seg in enumerate(segments):
        bare = letters(seg)
        i = bare.find(wanted)
        at = [i for i, ch in enumerate(seg.translate(_GAPS)) if ch != "\x00"] if i >= 0 else []
        while i >= 0:
            a, b = at[i], at[i + len(wanted) - 1] + 1
            if (a == 0 or not _kept(seg[a - 1])) and (b == len(seg) or not _kept(seg[b])):
                return [*segments[:k], seg[:a], seg[b:], *segments[k + 1 :]], True
            i = bare.find(wanted, i + 1)
    return segments, False


def _pieces(text: str, sep: str) -> list[str]:
    """Text fields of a stretch without known fields: title, venue or both side by side."""
    parts = [p for p in re.split(sep, text) if squeeze(p)]
    if len(parts) < 2:
        return parts
    # A venue begins a field of its own; everything else that is adjacent belongs together.
    out: list[list[str]] = [[parts[0]]]
    for p in parts[1:]:
        if _VENUE.match(p) and not _VENUE.match(out[-1][0]):
            out.append([p])
        elif sep.startswith((r"\|", "(?:^")):
            out.append([p])
        else:
            out[-1].append(p)
    return [" ".join(x) for x in out]


def raw_fields(raw: str, title: str | None, authors: list[str] | None) -> list[str]:
    """Canonical fields of a raw string, sorted."""
    s = fold(raw)
    keys = list(_KEY.finditer(s))
    if len(keys) > 1 and {"title", "author"} & {m[1] for m in keys}:
        out = [squeeze(s[: keys[0].start()])]
        for m, nxt in zip(keys, [*keys[1:], None], strict=True):
            out.append(m[1] + "=" + squeeze(s[m.end() : nxt.start() if nxt else len(s)]))
        return sorted(x for x in out if x)
    fields: list[str] = []
    segments = [s]
    for part in (title, "".join(a or "" for a in authors or [])):
        wanted = letters(fold(part or ""))
        for tail in ("etal", ""):  # the list of names may leave out an et al. that the raw string has
            segments, found = _carve(segments, wanted + tail if wanted else "")
            if found:
                fields.append(squeeze(fold(part or "")) + tail)
                break
    dashed = "|" not in s and len(re.findall(r"(?<=\S)\s-\s(?=\S)", s)) > 1
    if "|" in s:
        sep = r"\|"
    elif dashed:
        sep = r"(?:^|\s)-(?:\s|$)"
    else:
        tight = _NUMBER.sub("#", " ".join(segments))
        flat = [a or b for a, b in re.findall(r"#\)?\s?([.,;])|([.,;]) \(?#", tight)]
        sep = r"[%s](?:\s|$)" % re.escape(max(sorted(set(flat)), key=flat.count)) if flat else r"[.,;](?:\s|$)"
    for seg in segments:
        last, numbers = 0, list((_TIGHT_NUMBER if dashed else _NUMBER).finditer(seg))
        for m in numbers:
            fields += map(squeeze, _pieces(seg[last : m.start()], sep))
            last = m.end()
        fields += map(squeeze, _pieces(seg[last:], sep))
        fields += _number_fields(seg, numbers, dashed)
    return sorted(f for f in fields if f)


def _number_fields(seg: str, numbers: list[re.Match], dashed: bool) -> list[str]:
    """Year, volume with issue, pages. Between dashes a page range may stand as two numbers of its own: of the
    neighbours in order that are no years, those whose end is least above their start in proportion. Without a volume beside them the range has to end before its start doubles."""
    out = ["#" + "-".join(re.findall(r"\d+", m[0])) for m in numbers]
    if not dashed:
        return out
    plain = [m[0].isdigit() and not 1500 <= int(m[0]) < 2100 for m in numbers]
    volume = sum(plain) > 2 or any(not m[0].isdigit() for m in numbers)  # stands for itself, so two plain numbers are the pages
    close = []
    for k, (a, b) in enumerate(zip(numbers, numbers[1:], strict=False)):
        if plain[k] and plain[k + 1] and seg[a.end() : b.start()].strip() == "-":
            first, last = int(a[0]), int(b[0])
            if first <= last and (volume or last < 2 * max(first, 10)):
                close.append((last / max(first, 1), k))
    if close and not any(re.fullmatch(rf"\d+\s*[{_DASH}]+\s*\d+", m[0]) for m in numbers):
        k = min(close)[1]
        out[k : k + 2] = [out[k] + "-" + out[k + 1][1:]]
    return out


def canonical_bytes(raw: str | None, title: str | None, authors: list[str] | None) -> bytes | None:
    """Equal for two records exactly if they differ in formatting alone."""
    if raw is None or not raw.strip():
        return None
    head = b"\x01" if title is None else b"\x02" + squeeze(fold(title)).encode()
    return head + b"\x1f" + "\x1e".join(raw_fields(raw, title, authors)).encode("utf-8", "surrogatepass")
