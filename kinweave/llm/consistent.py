"""One consistent form for text that looks the same but differs in its characters.

A transducer, compiled when it is first used, reads text once from left to right and takes the longest match at each place:
a run of plain text, a mapped sequence of characters within a grapheme cluster, or a character as it is. Its mapping is
computed from the character database for widths, joined letters, spaces, invisible characters and accents (precomposed,
as sequences, and in any order of marks) and checked for conflicts. Look-alike letters are the transducer's states: letters
are buffered until their word ends, together with what each of them would be in another alphabet, and a word that mixes
alphabets comes out in one of them.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinweave.session import python_path

# Letters that look alike, as rows of Latin, Greek, Cyrillic; a dot where an alphabet has none.
_ALIKE = """
A Α А|B Β В|C . С|E Ε Е|H Η Н|I Ι І|J . Ј|K Κ К|M Μ М|N Ν .|O Ο О|P Ρ Р|S . Ѕ|T Τ Т|X Χ Х|Y Υ У|Z Ζ .
a α а|c ϲ с|e . е|i ι і|j ϳ ј|o ο о|p ρ р|s . ѕ|x χ х|y . у|v ν .|u υ .|h . һ|k κ к|d . ԁ|q . ԛ|w . ԝ
"""
_SCRIPTS = ("Latin", "Greek", "Cyrillic")
# Characters without a mark of their own that the general categories do not tell.
_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u2800\u3164\uffa0"


def _sources() -> Iterator[tuple[str, str]]:
    """What is mapped to what, over the whole character set: single characters, and sequences to their one character."""
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs") or 0x20 <= cp < 0x7F:
            continue
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if c in _INVISIBLE or category == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            yield c, ""
        elif category in ("Zs", "Zl", "Zp") or c in "\t\n\v\f\r\x85":
            yield c, " "
        elif category == "Cc":
            yield c, ""
        elif kind in ("<wide>", "<narrow>"):
            yield c, unicodedata.normalize("NFKC", c)
        elif category[0] == "L" and kind in ("<compat>", "<initial>", "<medial>", "<final>", "<isolated>"):
            whole = unicodedata.normalize("NFKC", c)
            if len(whole) > 1 and all(x.isalpha() or unicodedata.combining(x) for x in whole):
                yield c, whole
        elif (one := unicodedata.normalize("NFC", c)) != c:
            yield c, one
        elif len(apart := unicodedata.normalize("NFD", c)) > 1:
            # Also where a part of the sequence is one character already.
            for k in range(1, len(apart)):
                yield unicodedata.normalize("NFC", apart[:k]) + apart[k:], c


class Transducer:
    """A tree of sequences with what they become; the longest match wins.

    Marks may stand in any order, with others and with invisible characters between them, as long as none of their own kind
    comes first; a state's way on is therefore looked for behind marks that lead nowhere, which follow what was matched.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.tree: dict = {}
        pairs = list(pairs)
        for source, target in pairs:
            node = self.tree
            for c in source:
                node = node.setdefault(c, {})
            if node.setdefault(None, target) != target:
                raise ValueError(f"{source!a} becomes both {node[None]!a} and {target!a}")
        self.cluster = lru_cache(1 << 16)(self._cluster)
        for source, target in pairs:
            if self.apply(target) != target:
                raise ValueError(f"what {source!a} becomes, {target!a}, becomes {self.apply(target)!a} in turn")

    def _cluster(self, part: str) -> str:
        """What a grapheme cluster becomes."""
        # Characters of their own first: invisible ones go, wide ones and joined letters become what they stand for.
        flat: list[str] = []
        for c in part:
            node = self.tree.get(c)
            flat.extend(c if node is None else unicodedata.normalize("NFD", node.get(None, c)))
        out: list[str] = []
        at = 0
        while at < len(flat):
            marks = at + 1
            while marks < len(flat) and unicodedata.combining(flat[marks]):
                marks += 1
            # The marks of a letter in their canonical order, which keeps the order of those of one kind.
            flat[at + 1 : marks] = sorted(flat[at + 1 : marks], key=unicodedata.combining)
            node, found, left, kind = self.tree.get(flat[at], {}), flat[at], [], 0
            k = at + 1
            while k < len(flat):
                c = flat[k]
                own = unicodedata.combining(c)
                if not own and left or not own and c not in node:
                    break
                if c in node and (kind < own or not left):
                    node = node[c]
                    found = node.get(None, found + c)
                else:
                    left.append(c)
                    kind = own
                k += 1
            out += [found, *left]
            at = k
        return "".join(out)

    def apply(self, text: str) -> str:
        return "".join(m if m.isascii() and m.isprintable() else self.cluster(m) for m in _STEP.findall(text))


#: A run of plain letters, a run of other plain text, or one grapheme cluster with the invisible characters inside and after
#: it; the longest wins.
_STEP = regex.compile(r"[A-Za-z]+(?![\p{M}\p{Cf}])|[ -@\[-`{-~]+(?![\p{M}\p{Cf}])|\X(?:[\p{Cf}\p{Mn}]+)?")


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer(_sources())


@lru_cache(1)
def alike() -> dict[tuple[str, str], dict[str, str]]:
    """(from alphabet, to alphabet) -> letters, also with a mark where both have one character for that; raises when a letter
    would have two forms in an alphabet."""
    out: dict[tuple[str, str], dict[str, str]] = {(a, b): {} for a in _SCRIPTS for b in _SCRIPTS if a != b}

    def put(i: int, j: int, a: str, b: str) -> None:
        if out[_SCRIPTS[i], _SCRIPTS[j]].setdefault(a, b) != b:
            raise ValueError(f"{a} has two forms in {_SCRIPTS[j]}")

    marks = [chr(c) for c in range(0x300, 0x370)]
    for row in _ALIKE.replace("\n", "|").split("|"):
        cells = row.split()
        for i, a in enumerate(cells):
            for j, b in enumerate(cells):
                if i != j and a != "." and b != ".":
                    put(i, j, a, b)
                    for m in marks:
                        x, y = (unicodedata.normalize("NFC", z + m) for z in (a, b))
                        if len(x) == len(y) == 1:
                            put(i, j, x, y)
    return out


@lru_cache(1 << 14)
def _script(c: str) -> str | None:
    return next((s for s in _SCRIPTS if _SCRIPT_OF[s].match(c)), None)


_SCRIPT_OF = {s: regex.compile(rf"\p{{Script={s}}}") for s in _SCRIPTS}
_IN_WORD = regex.compile(r"[\p{L}\p{M}]")


class _Word:
    """A word as it is read: as it stands, and as it would be in each alphabet as long as every letter has a form there.

    Letters that no other alphabet has decide; without any, the more frequent alphabet does, and the first one on a tie.
    """

    def __init__(self) -> None:
        self.own: list[str] = []
        self.forms: dict[str, list[str] | None] = {s: [] for s in _SCRIPTS}
        self.counts = dict.fromkeys(_SCRIPTS, 0)

    def add(self, c: str) -> None:
        self.own.append(c)
        script = _script(c)
        if script:
            self.counts[script] += 1
        for to, form in self.forms.items():
            if form is not None:
                x = c if script in (None, to) else alike()[script, to].get(c)
                if x is None:
                    self.forms[to] = None
                else:
                    form.append(x)

    def end(self) -> str:
        present = [s for s in _SCRIPTS if self.counts[s]]
        able = [s for s in present if self.forms[s] is not None]
        if len(present) < 2 or not able:
            return "".join(self.own)
        return "".join(self.forms[max(able, key=lambda s: self.counts[s])] or ())


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; applying it twice changes nothing."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    cluster = transducer().cluster
    out: list[str] = []
    word: _Word | None = None
    for part in _STEP.findall(text):
        part = part if part.isascii() and part.isprintable() else cluster(part)
        if word is None and part.isascii() and not part.isalpha():
            out.append(part)
            continue
        for c in part:
            if _IN_WORD.match(c):
                word = word or _Word()
                word.add(c)
            else:
                if word:
                    out.append(word.end())
                    word = None
                out.append(c)
    if word:
        out.append(word.end())
    done = "".join(out)
    # A mark may meet its letter only once what stood between is gone.
    return done if unicodedata.is_normalized("NFC", done) else consistent(unicodedata.normalize("NFC", done))


#: Printable ASCII from end to end; such text is in the form already.
_ORDINARY = r"\A[ -~]*\z"


@F.pandas_udf(StringType())
def _consistent_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([consistent(v) if isinstance(v, str) else None for v in s], dtype=object)


def with_consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with the columns in their consistent form. Null stays null, empty stays empty.

    Only rows with an unusual character in one of the columns go through Python.
    """
    python_path(df.sparkSession)
    unusual = reduce(lambda a, b: a | b, [F.coalesce(~F.col(c).rlike(_ORDINARY), F.lit(False)) for c in columns])
    return df.filter(~unusual).unionByName(df.filter(unusual).withColumns({c: _consistent_udf(c) for c in columns}))


def inconsistent(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`id, field, stored, form` of every value that is not in its consistent form; nulls never are."""
    python_path(df.sparkSession)
    long = df.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("stored")) for f in fields])).alias("x")).select("id", "x.*")
    # Only values with an unusual character reach Python.
    return long.filter(~F.col("stored").rlike(_ORDINARY)).withColumn("form", _consistent_udf("stored")).filter("form <> stored")
