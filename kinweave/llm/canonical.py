"""Mapping of free-entered values to a canonical list.

A symmetric-delete dictionary of the reference list travels to the tasks, and every value is looked up in a map-only step,
so hot values cost no shuffle. Candidates within a bounded edit distance are ranked by weighted Damerau-Levenshtein
distance, then by how often the reference entry is used. Values without a candidate are reported. A reference list too large
to broadcast meets the distinct values in a shuffle join on the same keys, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinweave.functions.uris import strip_blanks
from kinweave.session import python_path

UNMATCHED = "[unmatched]"
#: Largest reference list, in rows and in characters, that is broadcast: 256 deletions a form at most, so a million in all.
MAX_REFERENCE, MAX_REFERENCE_CHARS = 2_000, 200_000
#: Deletions are taken from so many leading letters. This loses nothing: of two words `k` operations apart, each operation leaves
#: at most one letter of either without a partner, and so the first letters of both, however many, become equal by at most `k`
#: deletions on either side.
PREFIX = 9
MAX_DISTANCE = 4

# Rows of the usual keyboard, for the weight of a substitution.
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_VOWELS = frozenset("aeiouy")
_AT = {c: (r, i + r / 2) for r, row in enumerate(_KEYS) for i, c in enumerate(row)}


def allowed(n: int) -> int:
    """Edit operations allowed for a word of `n` letters."""
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 9 else 3 if n < 14 else MAX_DISTANCE


def fold(s: str) -> str:
    """Letters and digits only, lower case, without accents."""
    s = unicodedata.normalize("NFKD", s).casefold()
    return "".join(c for c in s if c.isalnum())


def _words(s: str) -> list[str]:
    s = unicodedata.normalize("NFKC", s)
    return [fold(w) for w in re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s))]


def _substitution(a: str, b: str) -> float:
    if a in _VOWELS and b in _VOWELS:
        return 0.8
    p, q = _AT.get(a), _AT.get(b)
    return 0.7 if p and q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.1 else 1.0


def distance(a: str, b: str, most: float) -> tuple[int, float] | None:
    """Optimal-string-alignment distance as (operations, weight), or None beyond `most` operations.

    Adjacent keys, vowels, transpositions and doubled letters weigh less than other operations.
    """
    if abs(len(a) - len(b)) > most:
        return None
    rows: list[list[tuple[int, float]]] = [[(j, float(j)) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, float(i))]
        for j, y in enumerate(b, 1):
            up, left, diag = rows[i - 1][j], row[j - 1], rows[i - 1][j - 1]
            twice_a = 0.6 if i > 1 and x == a[i - 2] else 1.0
            twice_b = 0.6 if j > 1 and y == b[j - 2] else 1.0
            best = min((up[0] + 1, up[1] + twice_a), (left[0] + 1, left[1] + twice_b), diag if x == y else (diag[0] + 1, diag[1] + _substitution(x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                t = rows[i - 2][j - 2]
                best = min(best, (t[0] + 1, t[1] + 0.7))
            row.append(best)
        if min(c[0] for c in row) > most:
            return None
        rows.append(row)
    return rows[-1][-1] if rows[-1][-1][0] <= most else None


def _deletions(s: str) -> set[str]:
    """What is left of the first letters of a word after any deletions that are allowed for it."""
    head = s[:PREFIX]
    return {"".join(c) for k in range(min(allowed(len(s)), len(head)) + 1) for c in combinations(head, len(head) - k)}


def _initials(words: list[str]) -> str:
    """What an abbreviation keeps: how many words there are, and their first letters, or two of a single word."""
    return words[0][:2] if len(words) == 1 else "|".join(w[:1] for w in words)


def _abbreviates(words: list[str], entry: list[str]) -> int | None:
    """0 when each typed word begins or equals the entry's, 1 when it otherwise has its letters in order, else None."""
    for k, rule in enumerate((_begins, _shortens) if len(words) > 1 else (_begins,)):
        if all(w == e or rule(w, e) for w, e in zip(words, entry)):
            return k
    return None


def _may_abbreviate(words: list[str]) -> bool:
    return bool(words) and (len(words) == 1 or max(map(len, words)) > 2)


def _near(folded: str, name: str) -> tuple[int, float] | None:
    """Their distance, if it is allowed for both; an operation changes two letters of the one or the other at most."""
    most = min(allowed(len(folded)), allowed(len(name)))
    if not most or abs(len(folded) - len(name)) > most:
        return None
    a, b = Counter(folded), Counter(name)
    return distance(folded, name, most) if (a - b).total() + (b - a).total() <= 2 * most else None


class Dictionary:
    """A symmetric-delete dictionary over `(key, label, uses)`."""

    def __init__(self, entries: list[tuple[str, str, int]]):
        self.exact: dict[str, str] = {}
        self.uses: dict[str, int] = {}
        self.index: dict[str, list[str]] = {}
        self.phrases: dict[str, list[tuple[list[str], str]]] = {}
        for key, label, uses in sorted(entries, key=lambda e: (-e[2], e[0])):
            self.uses.setdefault(key, uses)
            for form in dict.fromkeys((key, label)):
                words, folded = _words(form or ""), fold(form or "")
                if not folded:
                    continue
                if words:
                    self.phrases.setdefault(_initials(words), []).append((words, key))
                if folded not in self.exact:
                    self.exact[folded] = key
                    for d in _deletions(folded):
                        self.index.setdefault(d, []).append(folded)
        self.lookup = lru_cache(1 << 16)(self._lookup)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.lookup = lru_cache(1 << 16)(self._lookup)

    def near(self, folded: str) -> tuple[float, int, str] | None:
        """The best (weight, -uses, key) within the allowed distance."""
        found = {name for d in _deletions(folded) for name in self.index.get(d, ())}
        return min(((got[1], -self.uses[key], key) for name in found if (got := _near(folded, name)) for key in (self.exact[name],)), default=None)

    def abbreviated(self, words: list[str]) -> str | None:
        """The only entry that the typed words shorten: as the beginnings of its words, or else as letters in order."""
        hits: dict[int, set[str]] = {}
        for entry, key in self.phrases.get(_initials(words), ()):
            if (rule := _abbreviates(words, entry)) is not None:
                hits.setdefault(rule, set()).add(key)
        best = hits[min(hits)] if hits else ()
        return next(iter(best)) if len(best) == 1 else None

    def _lookup(self, value: str) -> str:
        forms = list(_readings(value))
        for form in forms:
            if (key := self.exact.get(fold(form))) is not None:
                return key
        for form in forms:
            words = _words(form)
            if _may_abbreviate(words) and (key := self.abbreviated(words)):
                return key
        ranks = [r for form in forms if (r := self.near(fold(form)))]
        return min(ranks)[2] if ranks else UNMATCHED


def _begins(typed: str, full: str) -> bool:
    return 2 <= len(typed) < len(full) and full.startswith(typed)


def _shortens(typed: str, full: str) -> bool:
    if not 2 <= len(typed) < len(full) or typed[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in typed)


def _readings(value: str) -> Iterator[str]:
    """The value as typed and without what people write around it: namespaces, qualifiers, quotes, lead-ins, inversions."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip()
    s = re.sub(r"(?i)^[a-z][a-z0-9+.-]*://\S*?([^/#\s]+)[/#]*$", r"\1", s)
    s = re.sub(r"(?i)^ns\d+__", "", s)
    s = re.sub(r"(?i)_inbound$", "", s)
    seen = set()
    bare = re.sub(r"\s*[(\[][^()\[\]]*[)\]]\s*$", "", s) or s
    for x in (s, bare):
        for y in (x, re.sub(r"^[^:]*:\s+(?=\S)", "", x), re.sub(r"^.*?\s[-–—]\s+(?=\S)", "", x)):
            for z in (y, " ".join(reversed(y.split(",", 1))) if "," in y else y):
                if z not in seen and any(c.isalnum() for c in z):
                    seen.add(z)
                    yield z


def references(reference: DataFrame, key: str, label: str, uses: DataFrame | None = None) -> DataFrame:
    """`key, label, n`: the reference list with its frequency of use, from rows `(key, n)`; null keys and repeated rows do not count."""
    ref = reference.select(F.col(key).alias("key"), F.coalesce(F.col(label), F.col(key)).alias("label")).filter("key is not null").distinct()
    if uses is None:
        return ref.withColumn("n", F.lit(0).cast("long"))
    used = uses.select(F.col("key").alias("used"), "n")
    return ref.join(used, F.col("key") == F.col("used"), "left").select("key", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def build(ref: DataFrame) -> Dictionary | None:
    """The dictionary of `references`, or None when the list is too large to be broadcast."""
    size = ref.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("key") + F.length("label")).alias("chars")).first()
    if size["n"] > MAX_REFERENCE or (size["chars"] or 0) > MAX_REFERENCE_CHARS:
        return None
    return Dictionary([(r["key"], r["label"], r["n"]) for r in ref.collect()])


def map_values(df: DataFrame, column: str, ref: DataFrame, out: str) -> DataFrame:
    """Adds `out`: the key of `references` meant by `column`, `[unmatched]` when none is, null for null or blank values."""
    python_path(df.sparkSession)
    dictionary = build(ref)
    return _looked_up(df, column, dictionary, out) if dictionary else _joined(df, column, ref, out)


def _looked_up(df: DataFrame, column: str, dictionary: Dictionary, out: str) -> DataFrame:
    """Map-only. Each Arrow batch looks its distinct values up once, and each task remembers values across batches."""
    shared = df.sparkSession.sparkContext.broadcast(dictionary)

    @F.pandas_udf(StringType())
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = shared.value.lookup
        for s in batches:
            table = {v: (lookup(v) if v.strip() else None) for v in set(s.dropna())}
            yield pd.Series([table.get(v) for v in s], dtype=object)

    return df.withColumn(out, mapped(F.col(column)))


def _keyed(form: str, typed: bool) -> Iterator[tuple[str, str]]:
    """What brings a typed form and an entry's form together."""
    folded, words = fold(form), _words(form)
    if folded:
        yield "exact", folded
        if allowed(len(folded)):
            yield from (("near", d) for d in _deletions(folded))
    if words and (not typed or _may_abbreviate(words)):
        yield "short", _initials(words)


def _joined(df: DataFrame, column: str, ref: DataFrame, out: str) -> DataFrame:
    """The same by a shuffle join of distinct values and entries on their keys.

    Pairs are ranked as they meet and only their minimum is aggregated, so no value's candidates are ever gathered.
    """

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, k, form, *x) for v in pdf["value"] if v.strip() for k, form in enumerate(_readings(v)) for x in _keyed(form, True)]
            yield pd.DataFrame(rows, columns=["value", "k", "form", "kind", "at"])

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, n, form, *x) for key, label, n in zip(pdf["key"], pdf["label"], pdf["n"]) for form in dict.fromkeys((key, label)) for x in _keyed(form, False)]
            yield pd.DataFrame(rows, columns=["key", "n", "entry", "kind", "at"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for value, k, form, kind, key, n, entry in zip(*(pdf[c] for c in ("value", "k", "form", "kind", "key", "n", "entry"))):
                if kind == "exact":
                    rows.append((value, 0, k, 0, 0.0, -n, key))
                elif kind == "short":
                    if (rule := _abbreviates(_words(form), _words(entry))) is not None:
                        rows.append((value, 1, k, rule, 0.0, -n, key))
                elif got := _near(fold(form), fold(entry)):
                    rows.append((value, 2, 0, 0, got[1], -n, key))
            yield pd.DataFrame(rows, columns=["value", "stage", "k", "rule", "weight", "uses", "key"])

    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    a = values.mapInPandas(typed, "value string, k int, form string, kind string, at string").distinct()
    b = ref.mapInPandas(listed, "key string, n long, entry string, kind string, at string").distinct()
    met = a.join(b, ["kind", "at"]).drop("at").distinct().mapInPandas(meet, "value string, stage int, k int, rule int, weight double, uses long, key string")
    # An abbreviation must be of one entry only, by the stricter rule that has any.
    best = F.min(F.struct("weight", "uses", "key")).alias("best")
    steps = met.groupBy("value", "stage", "k", "rule").agg(best, (F.min("key") == F.max("key")).alias("single"))
    steps = steps.groupBy("value", "stage", "k").agg(F.min_by(F.struct("best", "single"), "rule").alias("s")).filter("stage <> 1 or s.single")
    chosen = steps.groupBy("value").agg(F.min(F.struct("stage", "k", "s.best")).alias("c")).select(F.col("value").alias("_value"), F.col("c.best.key").alias("_key"))
    meant = F.coalesce("_key", F.when(strip_blanks(F.col(column)) != "", UNMATCHED))
    return df.join(chosen, F.col(column) == F.col("_value"), "left").withColumn(out, meant).drop("_value", "_key")
