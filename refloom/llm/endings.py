"""How a text ends: at the end of a sentence, in something that needs none, or inside a sentence.

Defined cases
- null, empty and blank text: 'blank', never cut.
- a mark that says so ([cut], (more), an ellipsis after a broken word) makes the text cut, unless what
  stands before the mark is whole.
- a text of one line without terminator is a title unless it breaks off (function word, comma).
"""

from __future__ import annotations

import re

from refloom.llm.sentences import BEFORE_NUMBER, INNER

_MARK = re.compile(r"\s*(?:\[\s*(?:cut|\.\.\.|…|truncated|more)\s*\]|\((?:more|cut|continued|truncated)\)|<\s*truncated\s*>|…|\.\.\.|read more|>>+)\s*$", re.I)
_END = re.compile(r"(?:[.!?।॥؟۔။។።。！？｡]|…|\.\.\.)(?:\s?[»›]|[\"”“’'」』)\]）】*_]|</?[A-Za-z]+>)*(?:\s?\[\d+(?:\s*[,;–-]\s*\d+)*\])*[.。]?$")
_SPACELESS = re.compile(r"[฀-໿က-႟ក-៿]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
# Words that never end a title.
_OPEN_WORDS = frozenset(
    "a an the of in on at to for from with by and or but as that which is are was were be than into over under between without while if because although their its our his her this these those each no not only "
    "der die das den dem des ein eine einer einem einen und oder mit von zu bei im am le la les l un une des du de et ou à pour par sur dans el los las un una y o del al con por en para que и в на с по для от к не".split()
)
_LABEL = re.compile(r"^(?:[A-Z][\w ]{0,24}:\s|(?:Table|Figure|Fig\.|Tab\.|Abb\.|Tabelle|Tableau|Tabla|Рис\.|Табл\.)\s*\d+\s*[:.])")
_HEADING = re.compile(r"^(?:\d{1,2}(?:\.\d{1,2})*\.?|[IVX]{1,5}\.)\s+\S+(?:\s+\S+){0,5}$")
_LINK = re.compile(r"^(?:https?://|www\.)\S+$")
_FORMULA = re.compile(r"^[\w^()]{1,12}\s*=\s*[-+*/^().\w\s]{1,40}$")
_CODE = re.compile(r"[;{}]$|^\s*(?:return|import|def|for|if|print|var|let|const|#include|<|\\|\$)\b|\)\s*$|</?\w+[^<>]*>$|<\|[^|]*\|>$|```$|\|$|^[=#*_~-]{3,}$")


def split_mark(text: str) -> tuple[str, bool]:
    """Text without a trailing mark of truncation, and whether it had one."""
    s = text.rstrip()
    m = _MARK.search(s, max(0, len(s) - 60))
    if not m:
        return s, False
    if m[0].strip() in ("...", "…") and not m[0][0].isspace() and s[: m.start()][-1:].isalpha():
        return s, False  # may be the ellipsis of a whole sentence
    return s[: m.start()].rstrip(), True


def ending(text: str | None) -> tuple[str, str]:
    """(kind, last word or run): kind is blank, stop, abbreviation, label, heading, line (a heading by its looks), list, link,
    formula, code, title, spaceless or open."""
    if text is None or not text.strip():
        return "blank", ""
    s = text.rstrip()
    lines = [x.strip() for x in re.split(r"[\n\r]+", s) if x.strip()]
    line = lines[-1]
    word = s.rsplit(None, 1)[-1]
    if _END.search(s):
        bare = re.sub(r"[^\w.]+$", "", word)
        tok = re.sub(r"^\W+", "", bare).rstrip(".").lower()
        if word.startswith(("http://", "https://")) and not _LINK.match(line):
            return "open", word
        if bare.endswith(".") and s.endswith(".") and (tok in INNER or tok in BEFORE_NUMBER - {"aprox", "s", "p"} or (len(tok) == 1 and tok.isalpha() and bare[-2].isupper())):
            return "abbreviation", tok
        return "stop", word
    if _LINK.match(line):
        return "link", word
    if re.match(r"^[-*•–—·]\s+\S", line):
        return "list", word
    if _LABEL.match(line) and len(line) < 200:
        return "label", word
    if len(lines) > 1 and _FORMULA.match(line):
        return "formula", word
    if len(lines) > 1 and line.startswith("(") and line.endswith(")"):
        return "label", word
    if len(lines) > 1 and (_HEADING.match(line) and _titled(line) or line.isupper() and len(line) > 3) and len(line) < 60:
        return "heading", word
    if len(lines) > 1 and _CODE.search(line) and not re.search(r"[a-z]{3,} [a-z]{3,} [a-z]{2,}", line):
        return "code", word
    if _SPACELESS.match(s[-1]) or (_SPACELESS.search(line) and s[-1] in "%0123456789"):
        return "spaceless", word[-8:]
    if len(lines) == 1 and not re.search(r"[.!?。！？।؟]\s", s) and not _CJK.search(s):
        return "title", word
    if len(lines) > 1 and len(line.split()) < 6 and _titled(line):
        return "line", word
    return "open", word


def _titled(line: str) -> bool:
    words = re.sub(r"^[\dIVX.]+\s+", "", line).split()
    return bool(words) and all(w[0].isupper() and (len(w) > 2 or len(words) > 1) or w in ("and", "of", "the", "in", "for") for w in words) and words[-1][0].isupper()


def is_open_word(word: str) -> bool:
    return word.lower() in _OPEN_WORDS or word.endswith((",", ";", ":", "-", "(", "«", "“", "„"))
