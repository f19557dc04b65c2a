"""Names of persons and organisations as people type them: parsing, and how well two of them agree."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from kinweave.llm.consistent import consistent

# Heads of corporate names with their abbreviations, and words that do not tell bodies apart.
HEADS = {
    "academy": "acad", "association": "assoc assn", "bureau": "", "college": "coll", "committee": "comm", "conservatory": "conserv conservatoire", "council": "", "department": "dept dep", "foundation": "found", "institute": "inst",
    "library": "lib", "ministry": "min", "museum": "mus", "office": "off", "press": "", "school": "sch", "society": "soc", "university": "univ", "orchestra": "orch", "company": "co", "commission": "",
}
_FILLERS = frozenset("of for the at in and on de la".split())
_HONORIFICS = frozenset("dr prof sir mr mrs ms rev jr sr".split())
_SHORT = {n: full for full, short in HEADS.items() for n in (full, *short.split())}


class Name(NamedTuple):
    """`kind` is `person`, `body` or `none`; a body's `family` holds its place words, its `given` the sorted other words."""

    kind: str
    family: tuple[str, ...]
    given: tuple[str, ...]
    born: int | None
    died: int | None


def fold(s: str) -> str:
    """Lower case without accents, in the consistent form."""
    s = unicodedata.normalize("NFKD", (consistent(s) or "").casefold())
    s = "".join(c for c in s if not unicodedata.combining(c))
    return s.translate(_STROKES)


_STROKES = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe"})


def _years(s: str | None) -> tuple[int | None, int | None]:
    s = s or ""
    if m := re.search(r"(\d{4})\s*[-–—]\s*(\d{4})?", s):
        return int(m[1]), int(m[2]) if m[2] else None
    if m := re.search(r"\bd\.\s*(\d{4})", s):
        return None, int(m[1])
    if m := re.search(r"\b(\d{4})\b", s):
        return int(m[1]), None
    return None, None


def parse(author: str | None, dates: str | None = None) -> Name:
    """The first reading of a heading."""
    return readings(author, dates)[0]


@lru_cache(1 << 16)
def readings(author: str | None, dates: str | None = None) -> tuple[Name, ...]:
    """A heading in any of its usual forms; null, blank and wordless headings have kind `none`.

    Without a comma either end of a personal name may hold the family name, and both readings are given, unless one end is
    an initial.
    """
    text = fold(author or "")
    born, died = _years(dates)
    if m := re.search(r",?\s*(?:b\.\s*)?\d{4}\s*(?:[-–—]\s*(?:\d{4})?)?\.?\s*$", text):
        b, d = _years(m.group())
        born, died = born or b, died or d
        text = text[: m.start()]
    words = re.findall(r"[^\W\d_]+", text)
    if not words:
        return (Name("none", (), (), born, died),)
    head = next((w for w in words if w in _SHORT and (len(w) > 3 or f"{w}." in text or w == "lib")), None)
    if head and len(words) > 2:
        return (_body(text, words),)
    if "," in text:
        left, right = (tuple(w for w in re.findall(r"[^\W\d_]+", x) if w not in _HONORIFICS) for x in text.split(",", 1))
        return (Name("person", left or right[:1], right if left else right[1:], born, died),)
    # What a hyphen joins stays together.
    parts = [p for x in text.split() if (p := tuple(w for w in re.findall(r"[^\W\d_]+", x) if w not in _HONORIFICS))] or [tuple(words)]
    flat = lambda ps: tuple(w for p in ps for w in p)
    ends = [Name("person", parts[-1], flat(parts[:-1]), born, died)]
    if len(parts) > 1:
        ends.append(Name("person", parts[0], flat(parts[1:]), born, died))
    return tuple(n for n in ends if max(map(len, n.family)) > 1) or tuple(ends[:1])


def _body(text: str, words: list[str]) -> Name:
    place = ""
    if m := re.search(r"\(([^()]+)\)", text):
        place = m[1]
    elif m := re.search(r"^([^\W\d_]+)\.\s+(?=\S+\s)", text):
        place = m[1] if m[1] not in _SHORT else ""
    if not place and "," in text:
        place = text.rsplit(",", 1)[1]
    where = [w for w in re.findall(r"[^\W\d_]+", place) if w not in _FILLERS]
    topic = sorted({_SHORT.get(w, w) for w in words if w not in _FILLERS and w not in where})
    if not where:
        # Without punctuation the place is at either end; it is never a head, and it is the longer end word.
        plain = [w for w in words if w not in _FILLERS]
        ends = [w for w in (plain[0], plain[-1]) if w not in _SHORT]
        where = [max(ends, key=len)] if ends else []
        topic = [w for w in topic if w not in where]
    return Name("body", tuple(sorted(where)), tuple(topic), None, None)


def osa(a: str, b: str, most: int) -> int:
    """Optimal-string-alignment distance, or `most` + 1 when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return min(prev[-1], most + 1)


def typo_limit(n: int) -> int:
    """Typing errors allowed in a word of `n` letters."""
    return 0 if n < 4 else 1 if n < 8 else 2


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    most = typo_limit(max(len(a), len(b))) if min(len(a), len(b)) > 2 else 0
    if not most or len(set(a) ^ set(b)) > 2 * most:  # an operation changes two letters at most
        return 0.0
    d = osa(a, b, most)
    return 1.0 - 0.12 * d if d <= most else 0.0


#: Given names -> the fuller names that they may stand for.
Fulls = dict[str, tuple[str, ...]]


def given_agreement(a: str, b: str, fulls: Fulls = {}) -> float:  # noqa: B006
    """1 for equal given names, less for short forms, typing errors, beginnings and initials, 0 for different ones."""
    if a == b:
        return 1.0
    best = 0.0
    for k, x in enumerate((a, *fulls.get(a, ()))):
        for m, y in enumerate((b, *fulls.get(b, ()))):
            short, full = sorted((x, y), key=len)
            if len(short) == 1:
                got = 0.7 if full[0] == short else 0.0
            else:
                got = 0.8 if len(short) <= 4 and full.startswith(short) and x != y else 0.9 * _alike(x, y) if x != y else 1.0
            best = max(best, got if k + m == 0 else 0.9 * got)
    return best


def family_agreement(a: Name, b: Name) -> float:
    """Best agreement of the family names' parts, after their whole."""
    whole = _alike("".join(a.family), "".join(b.family))
    parts = max((_alike(x, y) for x in a.family for y in b.family if min(len(x), len(y)) > 3), default=0.0)
    return max(whole, 0.95 * parts)


def agreement(a: Name, b: Name, fulls: Fulls = {}) -> float:  # noqa: B006
    """How well two names agree, from 0 (they cannot be the same) to 1."""
    if a.kind != b.kind or a.kind == "none":
        return 0.0
    if a.kind == "body":
        place = max((_alike(x, y) for x in a.family for y in b.family), default=0.0)
        if not place or len(a.given) != len(b.given):
            return 0.0
        # Sorted words may change order by a typing error, so each finds its best partner.
        each = [max((_alike(x, y) for y in b.given), default=0.0) for x in a.given] + [max((_alike(x, y) for x in a.given), default=0.0) for y in b.given]
        return place * min(each) if min(each, default=0.0) else 0.0
    if a.born and b.born and a.born != b.born or a.died and b.died and a.died != b.died:
        return 0.0
    family = family_agreement(a, b)
    if not family:
        return 0.0
    if not a.given or not b.given:
        return 0.5 * family
    first = given_agreement(a.given[0], b.given[0], fulls)
    if not first:
        return 0.0
    middle = 0.85
    if len(a.given) > 1 and len(b.given) > 1:
        m = given_agreement(a.given[1], b.given[1], fulls)
        if not m:
            return 0.0
        middle = 0.9 + 0.1 * m
    dated = 1.0 if a.born and a.born == b.born or a.died and a.died == b.died else 0.95
    return family * (0.4 + 0.6 * first) * middle * dated


def best_agreement(a: tuple[Name, ...], b: tuple[Name, ...], fulls: Fulls = {}) -> float:  # noqa: B006
    """The best agreement of any two readings."""
    return max(agreement(x, y, fulls) for x in a for y in b)


def kin(a: tuple[Name, ...], b: tuple[Name, ...]) -> tuple[str, str, str] | None:
    """`family, given, given` of two persons with the very same family name whose first given names are not just spelled differently,
    and whose dates do not contradict each other; the given names in order."""
    for x in a:
        for y in b:
            if x.kind == y.kind == "person" and x.family == y.family and x.given and y.given and not (x.born and y.born and x.born != y.born or x.died and y.died and x.died != y.died):
                g, h = sorted((x.given[0], y.given[0]))
                if len(g) > 1 and len(h) > 1 and not _alike(g, h):
                    return " ".join(x.family), g, h
    return None
