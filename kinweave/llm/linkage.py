"""Probabilistic record linkage of two tables without a common key.

Several blocking passes bring records together that agree on an identifier or on parts of title, author and year. Each
pair is compared attribute by attribute into a few agreement levels; expectation-maximisation over the counts of level
patterns estimates how probable each level is among matches and non-matches, and the posterior of a pattern is the
confidence of its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm import names
from kinweave.llm.consistent import consistent
from kinweave.llm.meeting import MAX_PAIRS, meet
from kinweave.session import checkpoint, python_path, spread

#: Confidence from which a pair counts as a match.
CONFIDENCE = 0.5
#: A title is common when more than this share of the left records bear it, beside the few deliveries and editions of one work.
COMMON_TITLE, OF_ONE_WORK = 0.001, 7
#: Shortest title words that are blocking keys beside an author or a year.
KEY_WORD = 4

# Agreement levels. 0 is always "not known on either side".
TITLE = ("none", "different", "numbers differ", "near", "equal, common", "equal, rare")
AUTHOR = ("none", "different", "same family name", "compatible", "same")
IDENT = ("none", "different", "one edit", "equal")
YEAR = ("none", "different", "one digit", "equal")
#: Identifier and year are one attribute, as they are not independent.
_SHAPE = (len(TITLE), len(AUTHOR), len(IDENT) * len(YEAR))


@lru_cache(1 << 16)
def title_forms(title: str | None) -> tuple[str, ...]:
    """The folded title, then what stands before its last subtitle and before a parallel title, and without a short first
    word, which may be an article; empty for null or wordless."""
    s = names.fold(title or "").replace("&", " and ")
    out = []
    for x in (s, re.sub(r"\s*:[^:]*$", "", s), s.split(" = ")[0], s.split(" : ")[0]):
        t = " ".join(re.findall(r"\w+", x))
        if t and t not in out:
            out.append(t)
    words = out[0].split() if out else []
    return (*out, " ".join(words[1:])) if len(words) > 3 and len(words[0]) < 5 else tuple(out)


def lccn(value: str | None) -> str | None:
    """An LCCN in its normal form: no blanks, nothing from a slash on, the serial part padded to six digits."""
    s = re.sub(r"/.*", "", (consistent(value) or "")).strip()
    parts = [p for p in re.split(r"[-\s]+", s) if p]
    if len(parts) > 1 and parts[-1].isdigit():
        parts[-1] = parts[-1].zfill(6)
    return "".join(parts).lower() or None


def year(value: str | None) -> str | None:
    m = re.search(r"\d{4}", value or "")
    return m[0] if m else None


def _masks(y: str) -> list[str]:
    return [y[:i] + "_" + y[i + 1 :] for i in range(len(y))]


@lru_cache(1 << 16)
def families(author: str | None) -> tuple[str, ...]:
    """Every part, and the whole, of what may be the family name; of a body, its place."""
    return tuple(dict.fromkeys(w for n in names.readings(author, None) for w in (*n.family, "".join(n.family)) if w))


def blocks(title: str | None, author: str | None, ident: str | None, when: str | None) -> list[int]:
    """The hashed blocking keys of one record, all passes together. Equal hashes of different keys only add pairs."""
    out = {f"L|{ident}"} if ident else set()
    family = families(author)
    forms = title_forms(title)
    for t in forms:
        out.add(f"T|{t}")
        out |= {f"TY|{t}|{m}" for m in (_masks(when) if when else ())}
    words = sorted({w for w in forms[0].split() if len(w) >= KEY_WORD}) if forms else []
    out |= {f"AW|{f}|{w}" for f in family for w in words}
    if len(words) < 2:  # of a short title a typing error may leave no word, so what remains after any one deletion
        out |= {f"AD|{f}|{t[:i]}{t[i + 1 :]}" for f in family for t in forms for i in range(len(t) + 1)}
    if when:
        out |= {f"YW|{when}|{a}|{b}" for i, a in enumerate(words) for b in words[i + 1 :]}
    if ident and len(ident) == 10:
        out |= {f"A|{f}|{m}" for f in family for m in (ident[:5], ident[5:])}
    return [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in out]


# Pairs of a common title, or of two prolific authors, come again and again.
@lru_cache(1 << 16)
def _level_title(a: str | None, b: str | None, common: bool) -> int:
    fa, fb = title_forms(a), title_forms(b)
    if not fa or not fb:
        return 0
    if fa[0] == fb[0] or fb[0] in fa or fa[0] in fb:
        return 4 if common else 5
    best = 1
    for x, y in ((fa[0], fb[0]), (fa[0], fb[-1]), (fa[-1], fb[0])):
        dx, dy = re.findall(r"\d+", x), re.findall(r"\d+", y)
        most = max(1, min(len(x), len(y)) // 8)
        if abs(len(x) - len(y)) > most:
            continue
        if len(set(x) ^ set(y)) > 2 * most or names.osa(x, y, most) > most:
            continue
        best = max(best, 2 if dx != dy else 4 if common else 3)  # a typing error leaves a common title as common as it was
    return best


def _level_text(a: str | None, b: str | None) -> int:
    if not a or not b:
        return 0
    return 3 if a == b else 2 if names.osa(a, b, 1) == 1 else 1


@lru_cache(1 << 16)
def _level_author(a: str | None, b: str | None) -> int:
    x, y = names.readings(a, None), names.readings(b, None)
    if "none" in (x[0].kind, y[0].kind):
        return 0
    if (s := names.best_agreement(x, y)) > 0:
        return 4 if s >= 0.75 else 3
    if len(x) > 1 and len(y) > 1:  # of two names in the same order the last words are the family names
        x, y = x[:1], y[:1]
    return 2 if any(p.kind == q.kind == "person" and names.family_agreement(p, q) for p in x for q in y) else 1


def _normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, years = pdf["ident"].map(lccn, na_action="ignore"), pdf["year"].map(year, na_action="ignore")
        ids, years = ids.where(ids.notna(), None), years.where(years.notna(), None)
        keys = [blocks(*r) for r in zip(pdf["title"], pdf["author"], ids, years)]
        head = [(title_forms(t) or [None])[0] for t in pdf["title"]]
        yield pd.DataFrame({"rec": pdf["rec"], "title": pdf["title"], "author": pdf["author"], "ident": ids, "year": years, "head": head, "forms": [list(title_forms(t)) for t in pdf["title"]], "family": [list(families(a)) for a in pdf["author"]], "blocks": keys})


def _prepared(df: DataFrame, title: str, author: str, ident: str, when: Column) -> tuple[DataFrame, DataFrame]:
    """Distinct attribute rows as they are stored, and with their normal forms and blocking keys; copies of a record are one row."""
    rows = df.select(F.col(title).alias("title"), F.col(author).alias("author"), F.col(ident).alias("ident"), when.cast("string").alias("year"))
    rows = checkpoint(rows.distinct().withColumn("rec", F.monotonically_increasing_id()))
    normal = rows.mapInPandas(_normal, "rec long, title string, author string, ident string, year string, head string, forms array<string>, family array<string>, blocks array<long>")
    return rows.select("rec", *[F.col(c).alias(f"raw_{c}") for c in ("title", "author", "ident", "year")]), checkpoint(normal)


def candidate_pairs(left: DataFrame, right: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Distinct `l, r` that share a block. Hot blocks are spread over tasks and met in whole, so no pair is left out."""
    kl, kr = (df.select(F.col("rec").alias(name), F.explode("blocks").alias("key")) for df, name in ((left, "l"), (right, "r")))
    return meet(kl, kr, max_pairs).distinct()


def _alike(x: Column, y: Column, most: Column) -> Column:
    """Whether two texts may be at most `most` typing errors apart; a transposition counts twice here."""
    return F.when(F.abs(F.length(x) - F.length(y)) <= most, F.levenshtein(x, y) <= 2 * most).otherwise(F.lit(False))


def levels(pairs: DataFrame) -> DataFrame:
    """`l, r, t, a, i, y` with the levels that the JVM can tell, and the texts of those it cannot (-1), else null.

    Most pairs of a block differ so much, or agree so plainly, that no text of theirs has to leave the JVM.
    """
    fl, fr = F.col("forms"), F.col("r_forms")
    first, last = (lambda f: F.get(f, F.lit(0))), (lambda f: F.element_at(f, -1))
    none = (F.size(fl) == 0) | (F.size(fr) == 0)
    equal = F.array_contains(fl, first(fr)) | F.array_contains(fr, first(fl))

    def near(x: Column, y: Column) -> Column:
        return _alike(x, y, F.greatest(F.lit(1), F.floor(F.least(F.length(x), F.length(y)) / 8)))

    t = F.when(none, 0).when(equal, F.when(F.col("common"), 4).otherwise(5)).when(near(first(fl), first(fr)) | near(first(fl), last(fr)) | near(last(fl), first(fr)), -1).otherwise(1)
    some = F.exists("family", lambda x: F.exists("r_family", lambda y: _alike(x, y, F.lit(2))))
    a = F.when((F.size("family") == 0) | (F.size("r_family") == 0), 0).when(some, -1).otherwise(1)
    il, ir, yl, yr = (F.col(c) for c in ("ident", "r_ident", "year", "r_year"))
    i = F.when(il.isNull() | ir.isNull(), 0).when(il == ir, 3).when(_alike(il, ir, F.lit(1)), -1).otherwise(1)
    digits = sum((F.substring(yl, k, 1) != F.substring(yr, k, 1)).cast("int") for k in range(1, 5))
    y = F.when(yl.isNull() | yr.isNull(), 0).when(yl == yr, 3).when((digits == 1) | (F.abs(yl.cast("int") - yr.cast("int")) == 1), 2).otherwise(1)
    got = pairs.withColumns({"t": t, "a": a, "i": i, "y": y})
    asked = [F.when(F.col(k) == -1, F.col(c)).alias(c) for k, cs in (("t", ("title", "r_title")), ("a", ("author", "r_author")), ("i", ("ident", "r_ident"))) for c in cs]
    return got.select("l", "r", "common", "t", "a", "i", "y", *asked)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = {c: p[c].to_numpy().copy() for c in ("l", "r", "t", "a", "i", "y")}
        for k, level, cs in (("t", _level_title, ("title", "r_title", "common")), ("a", _level_author, ("author", "r_author")), ("i", _level_text, ("ident", "r_ident"))):
            at = np.flatnonzero(out[k] == -1)
            out[k][at] = [level(*x) for x in zip(*(p[c].iloc[at] for c in cs))]
        yield pd.DataFrame({"l": out["l"], "r": out["r"], "t": out["t"], "a": out["a"], "iy": len(YEAR) * out["i"] + out["y"]})


#: Levels that cannot occur between records of one publication by the definition of one: (attribute, level).
Impossible = frozenset[tuple[int, int]]
#: Other numbers in the title are another volume; another identifier with another or unknown year is another edition.
PUBLICATION: Impossible = frozenset({(0, TITLE.index("numbers differ"))} | {(2, len(YEAR) * IDENT.index("different") + y) for y in range(len(YEAR)) if YEAR[y] != "equal"})


def _start() -> list[np.ndarray]:
    """Where the probabilities of levels among matches start from."""
    iy = np.full(_SHAPE[2], 1e-3)
    for i, y, p in ((3, 3, 0.4), (0, 3, 0.25), (3, 0, 0.1), (0, 0, 0.08), (3, 2, 0.05), (0, 2, 0.04), (2, 3, 0.04), (2, 0, 0.02), (2, 2, 0.005), (3, 1, 0.005), (1, 3, 0.005)):
        iy[len(YEAR) * i + y] = p
    return [np.array([0.02, 0.005, 0.01, 0.15, 0.12, 0.7]), np.array([0.05, 0.02, 0.05, 0.2, 0.68]), iy]


def apart(left: DataFrame, right: DataFrame, n_met: int) -> dict[tuple[int, int, int], float]:
    """Level patterns of all the pairs that share no block, which are no matches, from how often values are null and years occur.

    With them the probabilities among non-matches are those of any two records, and not of the few that blocking selects,
    among which attributes depend on each other. Nothing is collected but a row per year.
    """

    def side(df: DataFrame) -> tuple[int, list[float], dict[str, int]]:
        r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ("head", "author", "ident")]).first()
        years = {x["year"]: x["n"] for x in df.filter("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
        return r["n"], [r[c] / max(r["n"], 1) for c in ("head", "author", "ident")], years

    def masked(df: DataFrame, n: str) -> DataFrame:
        each = F.explode(F.transform(F.sequence(F.lit(0), F.length("ident")), lambda i: F.when(i == 0, F.col("ident")).otherwise(F.overlay("ident", F.lit("_"), i))))
        return df.filter("ident <> ''").select(each.alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).cast("double").alias(n))

    (nl, kl, yl), (nr, kr, yr) = side(left), side(right)
    # Pairs of identifiers that differ in one place share one mask, and equal ones share all.
    same = masked(left, "a").join(spread(masked(right, "b")), "mask").select((F.col("a") * F.col("b")).alias("n"), F.contains("mask", F.lit("_")).alias("open"), (F.length("mask")).alias("k"))
    near = same.agg(F.sum(F.when(F.col("open"), F.col("n")).otherwise(-F.col("k") * F.col("n")))).first()[0] or 0.0
    rest = max(float(nl) * nr - n_met, 0.0)
    if not rest:
        return {}
    when = np.zeros(len(YEAR))
    b, nb = np.array([int(y) for y in yr], int), np.array(list(yr.values()), float)
    for y, n in yl.items():
        level = np.where(b == int(y), 3, np.where((sum((b // 10**k % 10 != int(y) // 10**k % 10).astype(int) for k in range(4)) == 1) | (abs(b - int(y)) == 1), 2, 1))
        when += np.bincount(level, weights=n * nb, minlength=len(YEAR)) / (nl * nr)
    when[0] = 1 - when.sum()
    known = [x * y for x, y in zip(kl, kr)]
    one_edit = min(max(near / (nl * nr), 0.0), known[2])
    out = {}
    for t in (0, 1):
        for a in (0, 1):
            for i, share in enumerate((1 - known[2], known[2] - one_edit, one_edit)):
                for y in range(len(YEAR)):
                    out[t, a, len(YEAR) * i + y] = rest * float(share * when[y] * np.prod([k if level else 1 - k for level, k in zip((t, a), known)]))
    return out


def expectation_maximisation(counts: dict[tuple[int, int, int], float], impossible: Impossible = PUBLICATION, rounds: int = 200) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Share of matches, and per attribute the probabilities of its levels among matches and among non-matches.

    The levels named `impossible` have probability 0 among matches throughout.
    """
    pats = np.array(sorted(counts))
    n = np.array([counts[tuple(p)] for p in pats], float)
    start = _start()
    for k, level in impossible:
        start[k][level] = 0.0
    m = [x / x.sum() for x in start]
    u = [np.bincount(pats[:, k], weights=n, minlength=size) + 0.5 for k, size in enumerate(_SHAPE)]
    u = [x / x.sum() for x in u]
    share = 1e-4
    for _ in range(rounds):
        pm, pu = (np.prod([x[k][pats[:, k]] for k in range(len(_SHAPE))], axis=0) for x in (m, u))
        post = share * pm / (share * pm + (1 - share) * pu + 1e-300)
        before = share
        share = min(max(float((n * post).sum() / n.sum()), 1e-15), 0.9)
        for k, size in enumerate(_SHAPE):
            # A little of the starting point stays, so that levels the data never show keep a sensible place.
            mk = np.bincount(pats[:, k], weights=n * post, minlength=size) + 2.0 * start[k]
            uk = np.bincount(pats[:, k], weights=n * (1 - post), minlength=size) + 0.05
            m[k], u[k] = mk / mk.sum(), uk / uk.sum()
        if abs(before - share) < 1e-6 * share:
            break
    return share, m, u


def link(left: DataFrame, right: DataFrame, least: float = CONFIDENCE, impossible: Impossible = PUBLICATION) -> DataFrame:
    """`id, ext_id, confidence` of every match.

    Both sides hold `key, title, author, ident, year`. Null, empty and wordless attributes take part as "not known". Keys may
    repeat with other attributes; a pair then has the confidence of its best comparison. Rows with a null key match nothing.
    """
    python_path(left.sparkSession)
    (raw_l, nl), (raw_r, nr) = (_prepared(d, "title", "author", "ident", F.col("year")) for d in (left, right))
    n = max(nl.count(), 1)
    often = nl.filter("head is not null").groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OF_ONE_WORK + COMMON_TITLE * n).select("head", F.lit(True).alias("is_common"))
    pairs = candidate_pairs(nl, nr)
    # Never more titles than 1 / COMMON_TITLE can be common.
    texts = ("title", "author", "ident", "year", "forms", "family")
    l = nl.join(F.broadcast(often), "head", "left").select(F.col("rec").alias("l"), *texts, F.coalesce("is_common", F.lit(False)).alias("common"))
    r = nr.select(F.col("rec").alias("r"), *[F.col(c).alias(f"r_{c}") for c in texts])
    compared = checkpoint(levels(pairs.join(spread(l), "l").join(spread(r), "r")).mapInPandas(_compare, "l long, r long, t int, a int, iy int"))
    # At most as many rows as there are patterns.
    counts = {(x["t"], x["a"], x["iy"]): x["n"] for x in compared.groupBy("t", "a", "iy").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = left.sparkSession
    empty = spark.createDataFrame([], "id string, ext_id string, confidence double")
    if not counts:
        return empty
    every = apart(nl, nr, sum(counts.values()))
    for p, k in counts.items():
        every[p] = every.get(p, 0.0) + k
    share, m, u = expectation_maximisation({p: k for p, k in every.items() if k > 0}, impossible)
    post = {}
    for p in counts:
        a, b = share * np.prod([m[k][x] for k, x in enumerate(p)]), (1 - share) * np.prod([u[k][x] for k, x in enumerate(p)])
        post[p] = float(a / (a + b)) if a + b > 0 else 0.0
    table = spark.createDataFrame([(*p, c) for p, c in post.items() if c >= least], "t int, a int, iy int, confidence double")
    good = compared.join(F.broadcast(table), ["t", "a", "iy"]).select("l", "r", "confidence")

    def keyed(df: DataFrame, raw: DataFrame, rec: str, key: str) -> DataFrame:
        d = df.select(F.col("key").alias(key), *[F.col(c).cast("string").alias(c) for c in ("title", "author", "ident", "year")]).filter(F.col(key).isNotNull()).distinct()
        same = [d[c].eqNullSafe(raw[f"raw_{c}"]) for c in ("title", "author", "ident", "year")]
        return d.join(spread(raw), same[0] & same[1] & same[2] & same[3]).select(F.col("rec").alias(rec), key)

    found = good.join(spread(keyed(left, raw_l, "l", "id")), "l").join(spread(keyed(right, raw_r, "r", "ext_id")), "r")
    return found.groupBy("id", "ext_id").agg(F.max("confidence").alias("confidence"))
