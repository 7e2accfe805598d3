"""Reading names as people type them, and comparing them.

Defined cases
- null, empty or letterless strings are no names. ``et al.`` and the like name nobody.
- a string that is one person in one place and another elsewhere (an initial that fits two) belongs
  to the one written most often.
"""

from __future__ import annotations

import re
import unicodedata

# Words of names.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md jr sr".split())
PARTICLES = frozenset("van von de la der den di da del dos du le al el bin ibn ten ter zu mc mac o".split())
NOBODY = frozenset("et al others and colleagues anonymous anon unknown".split())
GROUPS = {
    "collaboration": "collaboration", "collab": "collaboration", "coll": "collaboration", "consortium": "consortium", "consort": "consortium", "cons": "consortium", "wg": "working group", "group": "group", "grp": "group",
    "institute": "institute", "inst": "institute", "laboratory": "laboratory", "lab": "laboratory", "team": "team", "network": "network", "initiative": "initiative", "project": "project",
    "committee": "committee", "society": "society", "centre": "centre", "center": "centre", "department": "department", "dept": "department", "university": "university", "univ": "university",
}
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander alexandra", "andy": "andrew", "anya": "anna", "annie": "anna", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "bea": "beatriz", "beth": "elizabeth", "betty": "elizabeth",
    "bella": "isabella", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "chris": "christopher", "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah",
    "debbie": "deborah", "dick": "richard", "dima": "dmitri", "don": "donald", "ed": "edward", "eddie": "edward", "fran": "francisco", "frank": "francisco", "fred": "frederick", "freddy": "frederick", "gene": "eugene", "gosia": "malgorzata",
    "greg": "gregory", "hannes": "johannes", "hans": "johannes", "jan": "johannes", "jack": "john", "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "joe": "joseph", "jon": "jonathan", "josie": "josephine", "jo": "josephine",
    "kate": "katherine katrin", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "katya": "ekaterina", "kolya": "nikolai", "larry": "lawrence", "leo": "leonardo", "lexi": "alexandra", "sandra": "alexandra", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "liza": "elizabeth", "maggie": "margaret",
    "matt": "matthew", "max": "maximilian", "meg": "margaret", "mike": "michael", "misha": "mikhail", "mitya": "dmitri", "nate": "nathan", "nadya": "nadia", "nick": "nicholas", "nico": "nicholas", "pablo": "paul", "paco": "francisco", "pancho": "francisco", "pasha": "pavel", "pat": "patricia",
    "patty": "patricia", "peggy": "margaret", "pepe": "jose giuseppe", "beppe": "giuseppe", "pete": "peter", "phil": "philip", "rick": "richard", "rich": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sasha": "alexander alexandra", "steve": "stephen", "sue": "susanna", "susi": "susanna", "susie": "susanna", "suzy": "susanna",
    "ted": "theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "trish": "patricia", "tricia": "patricia", "val": "valerie", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vik": "vikram", "vova": "vladimir", "walt": "walter",
    "will": "william", "yasha": "yakov", "zoli": "zoltan", "zhenya": "eugene",
}


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Mn", "Cf"))
    for a, b in (("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("æ", "ae"), ("œ", "oe"), ("ð", "d"), ("ß", "ss"), ("ı", "i")):
        s = s.replace(a, b)
    return s


def read_name(name: str | None) -> tuple[list[str], list[str], list[str], str] | None:
    """(long tokens, initials, cut-short tokens, kind of group); order of a name does not matter."""
    if not name:
        return None
    s = fold(name).replace("’", "'").replace("`", "'")
    s = re.sub(r"[\d*†‡§¶]+", " ", s)
    s = re.sub(r"\b(Mc|Mac)\s+(?=[A-Z])", r"\1", s)
    s = re.sub(r"\b(O)\s*'\s*(?=\w)", r"\1", s)
    s = re.sub(r"\b(van|von|de|al|la|della|del)(?=[A-Z])", r"\1 ", s)
    long_: list[str] = []
    initials: list[str] = []
    short: list[str] = []
    group = ""
    raw = re.findall(r"[^\W\d_]+\.?|\.", s.replace("'", ""))
    bare = [t.rstrip(".") for t in raw if t != "."]
    if {b.casefold() for b in bare} <= NOBODY:
        return None
    only_upper = not re.search(r"[a-z]", s)
    for at, t in enumerate(raw):
        b, after = t.rstrip("."), raw[at + 1] if at + 1 < len(raw) else ""
        low = b.casefold()
        if not low or low in TITLES and (t.endswith(".") or len(bare) > 2 and not b.isupper()) or low == "the" and len(bare) > 1:
            continue
        if low in GROUPS and len(bare) > 1:
            group = GROUPS[low] if group != "working group" else group
        elif low == "working" and len(bare) > 1:
            group = "working group"
        elif len(low) == 1:
            initials.append(low)
        elif low in PARTICLES and b.isupper() and after.isupper() and len(after) > 3:
            continue
        elif len(bare) > 1 and not only_upper and not b.isupper() and (low in PARTICLES or (b[0].islower() and len(low) < 5 and re.search(r"[A-Z]", s))):
            continue
        elif len(low) <= 3 and b.isupper() and not only_upper and len(bare) > 1 and not (set(low) & set("aeiou") and len(low) == 3):
            initials.extend(low)
        elif len(low) <= 3 and b.isupper() and len(bare) == 2 and not only_upper:
            initials.extend(low)
        elif t.endswith(".") and 2 <= len(low) <= 6 and len(bare) > 1:
            short.append(low)
        else:
            long_.append(low)
    if not long_ and not short:
        return None
    return long_, initials, short, group


def trigrams(token: str) -> set[str]:
    p = f"##{token}##"
    return {p[i : i + 3] for i in range(len(p) - 2)}


#: Tokens of so many letters may have two slips.
TWO_SLIPS = 10


def near(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart (or two in long tokens).

    Tokens of up to five letters are too alike by nature (Mei and Wei, Nick and Rick).
    """
    least = min(len(a), len(b))
    return least > 5 and edit(a, b, 2) <= (2 if least >= TWO_SLIPS else 1)


KNOWN_GIVEN = frozenset(NICKNAMES) | frozenset(w for v in NICKNAMES.values() for w in v.split())


def near_given(a: str, b: str, beside_a: int, beside_b: int) -> bool:
    """Is the short token ``a`` a slip for ``b``? Only if ``b`` stands beside many names, ``a`` beside hardly any."""
    return min(len(a), len(b)) > 3 and beside_a <= 2 and beside_b >= 8 and a not in KNOWN_GIVEN and edit(a, b, 1) <= 1


def edit(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, as far as ``most``; only places that so many edits can reach are looked at."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    m, n = len(a), len(b)
    while m > k and n > k and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[k:m], b[k:n]
    m, n = len(a), len(b)
    if not m or not n:
        return min(max(m, n), most + 1)
    far = most + 1
    before, prev = [far] * (n + 1), [j if j <= most else far for j in range(n + 1)]
    for i in range(1, m + 1):
        cur = [far] * (n + 1)
        if i <= most:
            cur[0] = i
        x = a[i - 1]
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            d = prev[j - 1] + (x != y)
            if prev[j] < d:
                d = prev[j] + 1
            if cur[j - 1] < d:
                d = cur[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] < d:
                d = before[j - 2] + 1
            cur[j] = d
        if min(cur) > most:
            return far
        before, prev = prev, cur
    return min(prev[n], far)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    hits: list[str] = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    t = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    lead = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + 0.1 * lead * (1 - j)


def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, an initial or a nickname; Jaro-Winkler otherwise."""
    if a == b or (min(len(a), len(b)) == 1 and a[0] == b[0]):
        return 1.0
    if b in NICKNAMES.get(a, "").split() or a in NICKNAMES.get(b, "").split() or set(NICKNAMES.get(a, "").split()) & set(NICKNAMES.get(b, "").split()):
        return 1.0
    if min(len(a), len(b)) >= 2 and (a.startswith(b) or b.startswith(a)):
        return 0.95
    return jaro_winkler(a, b)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean of the best token similarities from the shorter to the longer list of tokens."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(max(token_similarity(x, y) for y in b) for x in a) / len(a)
