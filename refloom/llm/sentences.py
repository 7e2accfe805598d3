"""Sentence units of texts in any language or script, with code-point offsets.

A text is cut into lines, a line into a lattice: its nodes are the places where a unit may end, each
with a cost from the terminator and what stands around it (abbreviations, initials, numerals,
quotations, brackets, citation marks, the case of the next word), its arcs are possible units. The
cheapest path gives the units. Thai and Lao, which use neither blanks between words nor full stops, go
through a word lattice first: the gap between two runs of such text is an end where the word before is
a final particle or the word after opens a clause of its own. The dictionary holds function words and
openers, not the language: a word that is not in it tells nothing, and its gap is no end. Khmer and
Burmese have terminators of their own, which alone end their units.

Defined cases
- null, empty and blank text: no unit. Text without terminator: one unit per line.
- a line break that falls inside a sentence (no terminator before it, lower case after it) does not split.
- offsets count code points of the given text; units carry no outer white space and never overlap.
- any length: work is linear in the text; rows are independent, so skew in keys does not matter.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

# Abbreviations by what may follow them.
#: A name, a number or more of the sentence follows; never an end.
INNER = frozenset(
    "dr prof st mr mrs ms mt sr sra dra srta fr frl hr m mm mme mlle mgr me gen col lt capt rev hon cf vs fig figs eq eqs sec secs ch app no nos nr vol vols pp ed eds art arts abb bd hrsg vgl bzw bspw evtl ggf sog z d h u "
    "p.ej p.ex e.g i.e viz al-a pág págs núm cap ej ex см рис табл ср напр им гл стр проф акад г-н г-жа т डॉ श्री प्रो د أ م v ibid op loc inkl zzgl resp".split()
)
#: A number may follow, then no end; otherwise like any word.
BEFORE_NUMBER = frozenset("approx ca env aprox ок circa p s c jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic tel par § abs tab".split())
GERMAN_DATE = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert".split())
#: After an acronym with stops these begin a new sentence; other capitals carry its name on.
SENTENCE_OPENERS = frozenset(
    "a an the this that these those it its he she we they i you there here in on at for from with by as if when while although though because since after before however moreover furthermore thus hence therefore "
    "but and or so yet nor what why how who where is are was were do does did can could may might must should would will no not all some many most each every both other another our their his her my your".split()
)
#: After a closing quotation with its own terminator these carry the sentence on.
CARRY_ON = ("是", "的", "と", "って", "は", "が", "を", "に", "で", "も", "の", "や", "へ", "、", "，", "；", ",", ";", ":", "：")
CJK_END = "。！？｡"
OPENERS, CLOSERS = "“„«「『‚‘‹", "”»」』’›"
PAIR = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›"}

# Thai words for the lattice, by role.
THAI_OPENING = "การ ความ ผล ผลการ แบบจำลอง คลังข้อความ กราฟ ตัวอย่าง วิธี วิธีการ งานวิจัย งาน ทำไม ทั้งนี้ อย่างไรก็ตาม ดังนั้น นอกจากนี้ เรา ผู้เขียน ข้าพเจ้า เขา เธอ มัน นี่ นั่น สิ่ง ผม ดิฉัน ฉัน พวก อะไร ใคร เหตุใด เพราะเหตุใด เมื่อไร อย่างไร ข้อมูล ระบบ บทความ ตาราง รูป ภาพ สมการ บท ส่วน ผู้ นัก ชุด ค่า ตัว ดร ศาสตราจารย์".split()
THAI_FINAL = "ครับ ค่ะ คะ นะ จ้ะ แล้ว ฯลฯ ด้วย เลย เท่านั้น ไหม หรือไม่ หรือเปล่า เถอะ สิ ล่ะ".split()
THAI_FRONTED = "แม้ แม้ว่า ถ้า หาก เมื่อ ขณะที่ เนื่องจาก เพราะ สำหรับ จาก ใน ตาม โดย".split()
THAI_OTHER = "และ หรือ แต่ ที่ ซึ่ง ว่า ของ กับ ให้ ได้ ไม่ มี เป็น คือ อยู่ จะ ต้อง ใช้ ช่วย ลด เพิ่ม ยืนยัน อธิบาย แทนที่ เปรียบเทียบ ปรับปรุง วิเคราะห์ ทดลอง เลือก แหล่ง อ้างอิง กระจาย สัดส่วน คำ หา ยาก น้ำหนัก เส้น เชื่อม แม่นยำ จับคู่ คลาดเคลื่อน ข้อความ สั้น ทุก ใหม่ สัญญาณ รบกวน นี้ นั้น".split()
THAI_OPENING += "หลังจากนั้น จากนั้น ต่อมา สุดท้าย ในที่สุด เพราะฉะนั้น ฉะนั้น ยิ่งไปกว่านั้น อีกทั้ง ประการแรก ประการที่ กล่าวคือ ตัวอย่างเช่น แต่ทว่า ทว่า ท่าน คุณ พวกเขา พวกเรา หนู คน เด็ก ประเทศ รัฐบาล บริษัท โครงการ ปัญหา ปัจจุบัน วันนี้ เมื่อวาน พรุ่งนี้ นาย นาง นางสาว".split()
THAI_FINAL += "คับ จ้า จ๊ะ นะครับ นะคะ หรอก เช่นกัน เหมือนกัน".split()
THAI_FRONTED += "หลังจาก นอกจาก ถึงแม้ ทันทีที่".split()
THAI_OTHER += "ก่อน ระหว่าง ตั้งแต่ เพื่อ แม้แต่ ในขณะที่ มาก ที่สุด ก็ ถูก แก่ ต่อ ถึง ด้วยกัน กว่า อย่าง ยัง เคย กำลัง ควร อาจ สามารถ ทำ ไป มา โดยเฉพาะ รวมถึง เช่น".split()
# Lao words for the lattice, by role.
LAO_OPENING = "ການ ຄວາມ ຂ້ອຍ ຂ້າພະເຈົ້າ ພວກເຮົາ ເຮົາ ລາວ ເຂົາ ພວກເຂົາ ມັນ ເຈົ້າ ທ່ານ ດັ່ງນັ້ນ ນອກຈາກນັ້ນ ນອກຈາກນີ້ ຢ່າງໃດກໍຕາມ ຫຼັງຈາກນັ້ນ ຕໍ່ມາ ສຸດທ້າຍ ຜູ້ ນັກ ຂໍ້ມູນ ລະບົບ ວິທີ ຜົນ ບົດ ຮູບ ຕາຕະລາງ ປະເທດ ລັດຖະບານ ປັດຈຸບັນ ມື້ນີ້ ເປັນຫຍັງ ໃຜ".split()
LAO_FINAL = "ແລ້ວ ເດີ້ ເດ ເນາະ ແດ່ ດອກ ເລີຍ ເທົ່ານັ້ນ ຫຼືບໍ່ ບໍ່ລະ".split()
LAO_FRONTED = "ຖ້າ ຫາກ ເມື່ອ ຂະນະທີ່ ເນື່ອງຈາກ ເພາະ ເພາະວ່າ ສຳລັບ ສໍາລັບ ຈາກ ໃນ ຕາມ ໂດຍ ເຖິງແມ່ນວ່າ".split()
LAO_OTHER = "ແລະ ຫຼື ແຕ່ ທີ່ ຊຶ່ງ ເຊິ່ງ ວ່າ ຂອງ ກັບ ໃຫ້ ໄດ້ ບໍ່ ມີ ເປັນ ແມ່ນ ຢູ່ ຈະ ຕ້ອງ ໃຊ້ ນີ້ ນັ້ນ ກໍ".split()

_SPACELESS = re.compile(r"[฀-໿က-႟ក-៿]")
_SPACELESS_RUN = re.compile(r"[฀-໿က-႟ក-៿]+")
_TERM = re.compile(r"\.{2,}|…+|[.!?।॥؟۔။។։።]+|[。！？｡]+")
_KANA_OR_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
# Words and particles that end a sentence in Japanese and Chinese; before a blank they end it without a full stop.
CJK_FINAL = "です ます でした ました ません である であった ください でしょう ましょう だった ない なかった ている ていた のだ んだ だよ だね ですか ますか ですね ますね ですよ かな かしら 吗 呢 吧 啊 了".split()
_CJK_GAP = re.compile("(?:" + "|".join(sorted(CJK_FINAL, key=len, reverse=True)) + r")([ \u3000]+)(?=[「『“\"]?[぀-ヿ㐀-鿿])")
_CITE = re.compile(r"\[\d+(?:\s*[,;–-]\s*\d+)*\]")
_TAIL = re.compile(r"(?:\s?[»›]|[”“’'\"」』)\]）】])*")
_ENUM = re.compile(r"\(?(?:\d{1,3}(?:\.\d{1,3})*|[ivxIVX]{1,4}|[A-Za-z])\.?$")
_WORDS = {w: kind for kind, ws in (("open", THAI_OPENING + LAO_OPENING), ("final", THAI_FINAL + LAO_FINAL), ("front", THAI_FRONTED + LAO_FRONTED), ("", THAI_OTHER + LAO_OTHER)) for w in ws}
_LONGEST = max(map(len, _WORDS))


def word_lattice(run: str) -> list[tuple[str, str]]:
    """Cheapest cover of a spaceless run by dictionary words: (word, role); unknown stretches have role '?'."""
    n = len(run)
    cost, back = [0.0] + [1e9] * n, [(0, "?")] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + _LONGEST) + 1):
            role = _WORDS.get(run[i:j])
            if role is not None and cost[i] + 1.0 < cost[j]:
                cost[j], back[j] = cost[i] + 1.0, (i, role)
        step = 0.9 + (back[i][1] != "?") * 0.6  # an unknown letter costs less within an unknown stretch
        if cost[i] + step < cost[i + 1]:
            cost[i + 1], back[i + 1] = cost[i] + step, (i, "?")
    out, j = [], n
    while j:
        i, role = back[j]
        if role == "?" and out and out[-1][1] == "?":
            out[-1] = (run[i:j] + out[-1][0], "?")
        else:
            out.append((run[i:j], role))
        j = i
    return out[::-1]


def _roles(run: str) -> tuple[str, str, bool]:
    """Of a spaceless run: role of its first word, role of its last, and whether it is a fronted clause whose main clause is still to come."""
    words = word_lattice(run)
    fronted = words[0][1] == "front" and not any(role == "open" for _, role in words[1:])
    return words[0][1], words[-1][1], fronted


def _gap_ends(before: tuple[str, str, bool], after: tuple[str, str, bool]) -> bool:
    """Does the gap between two spaceless runs, given by their roles, end a unit?"""
    if before[1] == "final":
        return True
    return not before[2] and after[0] in ("open", "front")  # an unknown word tells nothing


def _quoted(s: str) -> list[tuple[int, int]]:
    """Spans [opener, after closer) of quotations and closed brackets."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    n = len(s)
    for m in _QUOTES.finditer(s):
        c, i = m[0], m.start()
        prev, nxt = s[i - 1] if i else " ", s[i + 1] if i + 1 < n else " "
        opening = c in "„«「『‹(（" or (c in "“\"" and (prev.isspace() or prev in "([（：:—" or not i) and not nxt.isspace())
        if c == "“" and not opening and stack and stack[-1][0] == "“" and not prev.isspace() and nxt.isalnum() and ord(nxt) > 0x2E7F:
            opening = False
        if c == "“" and ord(nxt) > 0x2E7F and not (stack and stack[-1][0] == "„"):
            opening = True
        if c in "”»」』›)）":
            opening = False
        if opening:
            stack.append((c, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            o = stack[k][0]
            if (o == c == '"') or c in PAIR.get(o, "") or (o in "(（" and c in ")）"):
                spans.append((stack[k][1], i + 1))
                del stack[k:]
                break
        else:
            if c in "”»」』":  # its opener lies before the text given
                spans.append((0, i + 1))
    for c, i in stack:
        if c not in "(（":  # not closed: the text given ends within it
            spans.append((i, n))
    return spans


def _outer(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _within(outer: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Does a span begin before ``a`` and end after ``b``?"""
    k = bisect_left(outer[0], a) - 1
    return k >= 0 and outer[1][k] > b


_BLANK, _LETTER, _GAP = re.compile(r"\s*"), re.compile(r"[^\W_]"), re.compile(r"(?<=\S)\s+(?=\S)")
_ACRONYM = re.compile(r"(?:[A-ZÀ-ÞА-Я]\.)+[A-ZÀ-ÞА-Я]$")
_OPEN_MARKS = "\"“„«「『'‘([¿¡（—–-"
#: The longest entry of the lists of abbreviations; a longer word is in none of them.
_LONGEST_SHORT = 16
_HEAD, _PART, _WHITE = re.compile(r"\S{0,32}"), re.compile(r"[^\s–-]{0,32}"), re.compile(r"\s")
_SPACED_CITE, _QUOTES, _OPENS = re.compile(r" (\[\d[\d,\s–-]*\])(?=\s|$)"), re.compile(r"[“”„«»「」『』‹›\"()（）]"), re.compile(r"[“”„«»「」『』‹›\"(（]")


class Line:
    """A line of text with the places that its nodes ask for again and again."""

    def __init__(self, s: str) -> None:
        self.s = s
        self._blanks: list[int] | None = None
        self._stops: tuple[list[int], list[int]] | None = None

    def word(self, at: int) -> str:
        """The word that begins at ``at``, as far as the lists of words reach."""
        return _HEAD.match(self.s, at)[0]

    def word_start(self, at: int) -> int:
        """Where the word before ``at`` begins."""
        near = self.s.rfind(" ", 0, at) + 1
        if not _WHITE.search(self.s, near, at):
            return near
        if self._blanks is None:
            self._blanks = [m.end() for m in _WHITE.finditer(self.s)]
        k = bisect_right(self._blanks, at)
        return self._blanks[k - 1] if k else 0

    def has_capital(self, at: int) -> bool:
        """Is there a capital in the part of the word from ``at`` on, up to a hyphen?"""
        near = _PART.match(self.s, at)
        if near.end() - at < 2 * _LONGEST_SHORT:
            return near[0] != near[0].lower()
        if self._stops is None:
            self._stops = [m.start() for m in re.finditer(r"[\s–-]", self.s)], [i for i, ch in enumerate(self.s) if ch.isupper()]
        ends, capitals = self._stops
        e, c = bisect_left(ends, at), bisect_left(capitals, at)
        return c < len(capitals) and capitals[c] < (ends[e] if e < len(ends) else len(self.s))


def _cost(line: Line, start: int, t: re.Match, tail_end: int, cited: bool, quotes: tuple[list[int], list[int]]) -> float:
    """Cost of ending a unit at this terminator: below zero for an end, above for none."""
    s, term, a, b = line.s, t[0], t.start(), t.end()
    if _within(quotes, a, tail_end):
        return 5.0
    begins = _BLANK.match(s, tail_end).end()
    if begins == len(s):
        return -5.0
    gap, nxt, closed = begins - tail_end, s[begins], tail_end > b and not cited
    if term[0] in CJK_END:
        if closed and s.startswith(CARRY_ON, begins):
            return 3.0
        return 3.0 if nxt in "，、；,;)）" else -3.0
    if nxt in "—–-" and begins + 2 < len(s) and s[_BLANK.match(s, begins + 1).end() :][:1].islower():
        return 3.0
    word = line.word(begins)
    head = word.lstrip(_OPEN_MARKS)
    if head[:4].lower() in ("http", "www.") and term == ".":
        return -1.0 if gap else 3.0
    if head[:1].islower() and not line.has_capital(begins + len(word) - len(head) + 1):
        return 3.0
    if nxt in ",;:)" or (nxt == "." and not gap):
        return 3.0
    if term[0] in "।॥؟۔။។։።":
        return -3.0
    caseless = bool(head) and head[0].isalpha() and not head[0].isupper() and not head[0].islower()
    if term[0] == "…" or len(term) > 1 and set(term) == {"."}:
        return 3.0 if not gap and caseless else -2.0
    if "!" in term or "?" in term:
        return -3.0 if gap or closed or cited or head[:1].isupper() else 3.0
    prev = s[max(start, line.word_start(a)) : a].lstrip(_OPEN_MARKS.rstrip("—–-"))
    low = prev.lower() if len(prev) <= _LONGEST_SHORT else ""
    last = prev[prev.rfind(".") + 1 :]
    if not gap and not closed and not cited:
        bare = prev.isalpha() or prev.endswith(("]", ")", "”", "%"))
        return -1.0 if bare and len(prev) > 1 and head[:1].isupper() and head[1:2].islower() and "/" not in prev and low not in INNER else 3.0
    if closed or cited:
        return -3.0
    if low and low in INNER or len(prev) - len(last) > 5 and len(last) <= _LONGEST_SHORT and last.lower() in INNER:
        return 4.0
    if low and low in BEFORE_NUMBER and head[:1].isdigit():
        return 4.0
    if len(prev) < 3 and prev.isdigit() and head.rstrip(".,").lower() in GERMAN_DATE:
        return 4.0
    if len(prev) <= _LONGEST_SHORT and _ENUM.match(prev) and not s[start : a - len(prev)].strip(" ("):
        return 4.0
    if len(prev) == 1 and prev.isalpha():
        before = s[start : a - 1].rstrip()
        if prev.islower() and before.endswith((".", "и")):
            return -1.0  # т. д., u. a., p. m. with a capital after it
        return 4.0  # an initial
    if low and _ACRONYM.match(prev) and head[:1].isupper() and head.rstrip(",.;:").lower() not in SENTENCE_OPENERS:
        return 2.0  # the U.S. Supreme Court
    return -2.0


def _spaceless_gaps(s: str, quotes: tuple[list[int], list[int]]) -> Iterator[tuple[int, float]]:
    """Gaps beside runs of scripts without blanks between words, with their costs."""
    runs = list(_SPACELESS_RUN.finditer(s))
    starts, stops = [r.start() for r in runs], [r.end() for r in runs]
    roles: dict[int, tuple[str, str, bool]] = {}

    def role(k: int) -> tuple[str, str, bool]:
        if k not in roles:
            roles[k] = _roles(runs[k][0])
        return roles[k]

    for m in _GAP.finditer(s):
        if _within(quotes, m.start(), m.start()):
            continue
        k, j = bisect_right(stops, m.start()) - 1, bisect_left(starts, m.end())
        # Figures and citation marks may stand between a run and the gap, opening marks between the gap and the next.
        left = k >= 0 and not _CITE.sub("", s[stops[k] : m.start()]).strip(" %0123456789.,[]()")
        right = j < len(runs) and not s[m.end() : starts[j]].strip("“\"«(")
        if left and right:
            yield m.start(), -1.0 if _gap_ends(role(k), role(j)) else 1.0
        elif left and s[m.end()].isupper():
            yield m.start(), -1.0


def _units(s: str, base: int) -> Iterator[tuple[int, int]]:
    """Units of one line, offset by ``base``."""
    spans = _quoted(s) if _OPENS.search(s) else []
    quotes, closings = _outer(spans), {q[1] for q in spans}
    nodes: list[tuple[int, float]] = []
    line, start = Line(s), len(s) - len(s.lstrip())
    for t in _TERM.finditer(s):
        end = _TAIL.match(s, t.end()).end()
        cite = _CITE.match(s, end)
        if cite:
            end = _TAIL.match(s, cite.end()).end()
        elif (spaced := _SPACED_CITE.match(s, end)) and t[0] != ".":
            end = spaced.end()
        # A closer in the tail counts only if it closes something here, else it opens the next unit.
        tail = s[t.end() : end]
        if tail.endswith(("“", '"')) and not cite and end < len(s) and not s[end].isspace() and end not in closings:
            end -= 1
        nodes.append((end, _cost(line, start, t, end, bool(cite), quotes)))
    if _SPACELESS.search(s):
        nodes += _spaceless_gaps(s, quotes)
    if _KANA_OR_HAN.search(s):
        nodes += [(m.start(1), -1.0) for m in _CJK_GAP.finditer(s) if not _within(quotes, m.start(1), m.start(1))]
    nodes.append((len(s), -9.0))
    nodes = _merged(nodes)
    # cheapest path; an arc without a letter or digit costs more than any terminator gives
    best: list[tuple[float, int]] = []
    bare: list[tuple[float, int]] = []  # the cheapest node since the last letter or digit
    full = (1e9, -1)  # cheapest earlier node with a letter or digit after it
    seen, lettered = start, False
    for k, (end, c) in enumerate(nodes):
        if _LETTER.search(s, seen, end):  # letters since the node before: every earlier node has one after it
            full, bare, lettered = min([full, *bare]), [], True
        seen = end
        whole = (0.0 if lettered else 20.0, -1)
        options = [whole] if start < end or k == 0 else []
        options += [full] if full[1] >= 0 else []
        options += [(p + 20, j) for p, j in bare]
        p, j = min(options, default=(1e9, -1))
        best.append((p + c, j))
        bare = [min([*bare, (p + c, k)])]
    k, ends = len(nodes) - 1, []
    while k >= 0:
        ends.append(nodes[k][0])
        k = best[k][1]
    at = start
    for end in reversed(ends):
        piece = s[at:end]
        a, b = end - len(piece.lstrip()), at + len(piece.rstrip())
        if a < b:
            yield base + a, base + b
        at = end


def _merged(nodes: list[tuple[int, float]]) -> list[tuple[int, float]]:
    out: dict[int, float] = {}
    for e, c in nodes:
        out[e] = min(c, out.get(e, c))
    return sorted(out.items())


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """[start, end) of every unit of a text."""
    if not text or not text.strip():
        return []
    lines: list[tuple[int, int]] = []
    for m in re.finditer(r"[^\n\r\x0b\x0c\x85  ]+", text):
        if not m[0].strip():
            continue
        if lines:
            prev, cur = text[lines[-1][0] : lines[-1][1]].rstrip(), m[0].lstrip()
            stop = prev[-1] in ".!?।॥؟۔။។:…。！？｡\"”»“」』)]" or unicodedata.category(prev[-1]) == "Po" and prev[-1] not in ",;"
            first = re.split(r"[\s-]", cur, maxsplit=1)[0]
            soft = not stop and cur[0].islower() and not any(c.isupper() for c in first[1:])
            if soft and text[lines[-1][1] : m.start()].count("\n") < 2:
                lines[-1] = (lines[-1][0], m.end())
                continue
        lines.append((m.start(), m.end()))
    return [u for a, b in lines for u in _units(text[a:b], a)]
