"""Frequencies, variants, linkage and leakage against brute force on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import leakage, linkage, meeting, termfreq, variants
from kinweave.session import estimated_bytes

# Term frequencies


def brute(rows):
    occ, rec = {}, {}
    for t, r in rows:
        if t is not None:
            occ[t] = occ.get(t, 0) + 1
            rec.setdefault(t, set())
            if r is not None:
                rec[t].add(r)
    return {t: (occ[t], len(rec[t])) for t in occ}


@pytest.mark.parametrize("bucket", [16, 16_384])
def test_frequencies(spark, bucket, monkeypatch):
    monkeypatch.setattr(termfreq, "RECORDS_PER_BUCKET", bucket)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), f"r{rng.randrange(200)}") for _ in range(3000)] + [("hot", "r1")] * 1000 + [("a", None), ("solo", "r7"), (None, None)]
    df = spark.createDataFrame(rows, "t string, r string").withColumns({"term": F.lit(1), "record": F.lit(2), "bucket": F.lit(3)})
    got = {x["term"]: (x["occurrences"], x["records"], x["mark"]) for x in termfreq.term_frequencies(df, "t", "r").collect()}
    want = brute(rows)
    assert {t: v[:2] for t, v in got.items()} == want
    assert got["hot"][2] == got["solo"][2] == "rare" and got["a"][2] == "common"


def test_bitmaps_are_dense_or_a_word(spark):
    """40,000 records in one bucket are 625 full words; a term of one record is one word."""
    df = spark.range(40_000).select(F.lit("t").alias("t"), F.col("id").cast("string").alias("r")).unionByName(spark.createDataFrame([("solo", "77")], "t string, r string"))
    post = termfreq.postings(df, "t", "r", 1)
    assert {r["term"]: r["count"] for r in post.groupBy("term").count().collect()} == {"t": 625, "solo": 1}
    assert {r["term"]: r["records"] for r in termfreq.frequencies(post).collect()} == {"t": 40_000, "solo": 1}


def test_postings_merge_by_union(spark):
    df = spark.createDataFrame([("t", f"r{k}") for k in range(50)], "t string, r string")
    p = termfreq.postings(df, "t", "r", 50)
    assert tuple(termfreq.frequencies(termfreq.merge(p, p)).first()) == ("t", 100, 50)


def test_no_terms(spark):
    df = spark.createDataFrame([], "t string, r string")
    assert termfreq.term_frequencies(df, "t", "r").count() == 0


# Variants


def classes(spark, rows):
    df = spark.createDataFrame(rows, "id long, author string, dates string").withColumns({"key": F.lit(1), "form": F.lit(2), "class": F.lit(3)})
    out = {}
    for r in variants.variant_classes(df, "id", "author", "dates").distinct().collect():
        out.setdefault(r["class"], set()).add(r["key"])
    return {frozenset(v) for v in out.values()}


#: Families under which short forms of given names can be learned.
FAMILIES = ["Baldromvik", "Teskunlarup", "Mornelquist", "Garvintosby", "Polderhaam", "Ruskenfeld", "Wimbortell", "Zandrimont"]
SHORT = {"Francis": "Frank", "Richard": "Dick", "Elizabeth": "Bess"}


def taught():
    """Headings that show each short form beside its name under every family, and more often the name."""
    given = list(SHORT)
    people = [(f + end, given[(k + j) % 3]) for j, end in enumerate(("", "sen", "wick")) for k, f in enumerate(FAMILIES)] + [(FAMILIES[0], "Elizabeth")]
    rows = [f"{f}, {x}" for f, g in people for x in (g, SHORT[g])] + [f"{f}{end}, {given[k % 3]}" for k, f in enumerate(FAMILIES) for end in ("berg", "land")]
    return [(1000 + k, author, None) for k, author in enumerate(rows)]


def test_variants(spark):
    rows = [
        (1, "Jordelbaunik, Francis", "1948-1984"), (2, "jordelbaunik, frank", None), (3, "Jordelbuanik, Francis", None), (4, "F. Jordelbaunik", None), (5, "Jordelbaunik, Odile", None), (6, "Cerjelsornik, Thomas", "1692-1725"),
        (7, "Cerjelsornik, Thomas", "1808-1841"), (8, "Lib. of Folk Music, Zordorpaciska", None), (9, "Zordorpaciska Library of Folk Music", None), (10, "Zordorpaciska Library of Applied Botany", None), (11, None, None), (12, " ?", None),
        (1, "Jordelbaunik, Francis", "1948-1984"), (13, "Jordelbaunik, Francis", "1948-1984"), (14, "Frank Jordelbaunik", None), (15, "Smith, Jo", None), (16, "Smyth, Joanna", None),
    ]
    got = {frozenset(k for k in c if k < 1000) for c in classes(spark, rows + taught())} - {frozenset()}
    assert got == {frozenset(x) for x in ({1, 2, 3, 4, 13, 14}, {5}, {6}, {7}, {8, 9}, {10}, {15, 16})}
    few = spark.createDataFrame(rows[:1] + rows[2:4] + rows[12:14], "id long, author string, dates string")
    assert variants.variant_pairs(variants.variant_classes(few, "id", "author", "dates")).count() == 6
    assert classes(spark, []) == set()


def test_short_forms_are_learned(spark):
    df = spark.createDataFrame(taught(), "id long, author string, dates string")
    profiles = df.select("author", "dates").distinct().mapInPandas(variants._profiles, variants._PROFILE).cache()
    got = {(r["given"], r["fuller"]) for r in variants.short_forms(variants.similar_profiles(profiles), profiles).collect()}
    assert got == {(s.lower(), g.lower()) for g, s in SHORT.items()}, got


def linkage_tree(n, sims, least):
    """Average linkage by always merging the closest pair."""
    groups = [{k} for k in range(n)]
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                m = sum(sims.get((min(a, b), max(a, b)), 0) for a in groups[i] for b in groups[j]) / len(groups[i]) / len(groups[j])
                if m >= least and (best is None or m > best[0] + 1e-12):
                    best = (m, i, j)
        if best is None:
            return {frozenset(g) for g in groups if len(g) > 1}
        groups[best[2]] |= groups.pop(best[1])


@pytest.mark.parametrize("seed", range(3))
def test_average_linkage_is_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    sims = {(a, b): round(rng.random(), 6) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.7}
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a long, b long, sim double")
    got = {}
    for r in variants.average_linkage(edges, 0.45).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == linkage_tree(14, sims, 0.45)


@pytest.mark.parametrize("cosine", [0.35, 0.5, 0.7])
@pytest.mark.parametrize("most", [50, 20_000])
def test_similar_texts_are_all_found(spark, monkeypatch, cosine, most):
    """Against all pairs, also with hot grams cut into parts."""
    monkeypatch.setattr(variants, "meet", lambda a, b: meeting.meet(a, b, most))
    rng = random.Random(5)
    part = ["kar", "mel", "dor", "vin", "bal", "sen"]
    texts = sorted({" ".join("".join(rng.choice(part) for _ in range(n)) for n in (3, rng.choice([1, 2]))) for _ in range(120)})
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {(r["a"], r["b"]): r["cosine"] for r in variants.similar_texts(nodes, cosine).collect()}
    grams = [variants.grams(t) for t in texts]
    df = {}
    for g in grams:
        for k in g:
            df[k] = df.get(k, 0) + 1
    vec = []
    for g in grams:
        v = {k: float(variants.weight(np.array(n, float), np.array(df[k], float), len(texts))) for k, n in g.items() if df[k] > 1}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vec.append({k: x / norm for k, x in v.items()})
    want = {(a, b): c for a in range(len(texts)) for b in range(a + 1, len(texts)) if (c := sum(x * vec[b].get(k, 0) for k, x in vec[a].items())) >= cosine}
    assert got == pytest.approx(want) and len(want) >= 20
    top = variants.similar_texts(nodes, cosine, top_n=1)
    assert 0 < top.count() <= len(got)


# Linkage


def test_linkage(spark):
    def side(rows):
        return spark.createDataFrame(rows, "key string, title string, author string, ident string, year string").withColumns({"l": F.lit(1), "rec": F.lit(2)})

    words = ["comet", "river", "lantern", "orchard", "signal", "harbour", "meadow", "copper", "violin", "glacier"]
    people = ["Jordelbaunik, Francis", "Cerjelsornik, Thomas", "Kelkaliruska, Dorothy", "Orbrehamisen, Henry"]
    own = [(f"b{k}", f"The {words[k % 10]} of {words[k // 10]}mar", people[k % 4], f"2090{k:06d}", str(1900 + k)) for k in range(100)]
    other = [(f"e{k}", f"THE {words[k % 10].upper()} OF {words[k // 10].upper()}MAR /", people[k % 4], None if k % 3 else f"2090-{k}", str(1900 + k) if k % 2 else None) for k in range(0, 60)]
    other += [("x1", own[3][1], people[0], "2089000001", "1850"), ("x2", own[5][1], "Another, Person", None, "1850"), ("n", None, None, None, None), ("e0", *other[0][1:]), (None, own[2][1], own[2][2], own[2][3], own[2][4])]
    got = {(r["id"], r["ext_id"]): r["confidence"] for r in linkage.link(side(own + [own[0], ("z", None, None, None, None)]), side(other)).collect()}
    assert set(got) == {(f"b{k}", f"e{k}") for k in range(60)}
    assert all(0.5 <= c <= 1 for c in got.values())
    assert linkage.link(side([]), side(other)).count() == 0


def test_blocking_loses_no_match(spark, monkeypatch):
    """What is linked with all pairs as candidates is linked with blocks, but for a few pairs in a hundred."""
    rng = random.Random(3)
    words = ["comet", "river", "lantern", "orchard", "signal", "harbour", "meadow", "copper", "violin", "glacier", "memoirs", "essays"]
    family = ["".join(rng.choice(["kar", "mel", "dor", "vin", "bal", "sen", "tul", "rog"]) for _ in range(4)) for _ in range(60)]

    def typo(s):
        k = rng.randrange(1, len(s) - 1)
        return rng.choice([s[:k] + s[k + 1 :], s[:k] + s[k + 1] + s[k] + s[k + 2 :], s[:k] + "x" + s[k:]]) if rng.random() < 0.3 else s

    own = [(f"b{k}", f"The {rng.choice(words)} of {rng.choice(words)}" if k % 4 else rng.choice(words[-2:]), f"{rng.choice(family)}, {rng.choice(['Odile', 'Henry', 'Jonas'])}", f"2090{k * 7919 % 10**6:06d}", str(1900 + k % 90)) for k in range(150)]
    other = [(f"e{k}", typo(t).upper(), typo(a) if k % 5 else None, i if k % 3 else None, y if k % 4 else None) for k, (_, t, a, i, y) in enumerate(own[:100])]
    schema = "key string, title string, author string, ident string, year string"
    a, b = spark.createDataFrame(own, schema), spark.createDataFrame(other, schema)
    got = {(r["id"], r["ext_id"]) for r in linkage.link(a, b).collect()}
    monkeypatch.setattr(linkage, "candidate_pairs", lambda l, r: l.select(F.col("rec").alias("l")).crossJoin(r.select(F.col("rec").alias("r"))))
    want = {(r["id"], r["ext_id"]) for r in linkage.link(a, b).collect()}
    assert len(want) > 80 and len(got & want) >= 0.98 * len(want)


def year_level(a, b):
    if not a or not b:
        return 0
    return 3 if a == b else 2 if sum(x != y for x, y in zip(a, b)) == 1 or abs(int(a) - int(b)) == 1 else 1


def test_levels_told_by_the_jvm_are_those_of_the_texts(spark):
    rng = random.Random(6)
    titles = ["The comet of Armar", "Comet of Armar", "The comte of Armar", "Essays", "Essasy", "River: a history", "River = Fluss", None, "", "The comet of Armar 2", "Some longer title of a book on rivers", "Some lnoger title of a bok on rivers"]
    authors = ["Jordelbaunik, Francis", "Jordelbuanik, F.", "Odile Jordelbaunik", "Jordelbaunik Odile", "Inst. of Folk Music, Kalgar", "Kalgar Institute of Folk Music", "Li, Bo", None, "?", "Bo Li", "Wenmor-Nalnis, Jonas", "Jonas Nalnis"]
    rows = [(k, rng.choice(titles), rng.choice(authors), rng.choice(["2090000012", "2090000021", "209000001", None]), rng.choice(["1999", "2000", "1989", "1850", None])) for k in range(60)]
    df = spark.createDataFrame(rows, "rec long, title string, author string, ident string, year string").mapInPandas(linkage._normal, "rec long, title string, author string, ident string, year string, head string, forms array<string>, family array<string>, blocks array<long>")
    l = df.drop("head", "blocks").withColumnRenamed("rec", "l").withColumn("common", F.col("l") % 2 == 0)
    r = df.select(F.col("rec").alias("r"), *[F.col(c).alias(f"r_{c}") for c in ("title", "author", "ident", "year", "forms", "family")])
    out = linkage.levels(l.crossJoin(r))
    told = {(x["l"], x["r"]): (x["t"], x["a"], x["i"]) for x in out.collect()}
    got = {(x["l"], x["r"]): (x["t"], x["a"], x["iy"]) for x in out.mapInPandas(linkage._compare, "l long, r long, t int, a int, iy int").collect()}
    want = {(k, m): (linkage._level_title(t, u, k % 2 == 0), linkage._level_author(a, b), 4 * linkage._level_text(i, j) + year_level(y, z)) for k, t, a, i, y in rows for m, u, b, j, z in rows}
    assert got == want
    assert 0.3 < np.mean([x >= 0 for v in told.values() for x in v]) < 1


def test_chance_agreement_is_counted_over_all_pairs(spark):
    """Rates of levels among records that share no block, against all pairs."""
    rng = random.Random(2)
    left, right = ([(k, rng.choice(["a", None]), rng.choice(["x", None]), rng.choice([f"2090{rng.randrange(500):06d}", None]), rng.choice([str(1900 + rng.randrange(30)), None])) for k in range(600)] for _ in "lr")
    schema = "rec long, head string, author string, ident string, year string"
    df, other = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = linkage.apart(df, other, 0)
    want = {}
    for _, h, a, i, y in left:
        for _, h2, a2, i2, y2 in right:
            edit = linkage._level_text(i, i2)
            # Equal identifiers never stand apart, so they count as known and different here; only one changed digit counts as near.
            level = 2 if edit == 2 and sum(p != q for p, q in zip(i, i2)) == 1 else min(edit, 1)
            p = (int(bool(h and h2)), int(bool(a and a2)), 4 * level + year_level(y, y2))
            want[p] = want.get(p, 0) + 1
    iy = lambda d: {k: sum(n for p, n in d.items() if p[2] == k) for k in range(12)}
    assert sum(got.values()) == pytest.approx(len(left) * len(right))
    for k, n in iy(want).items():
        assert iy(got)[k] == pytest.approx(n, rel=0.2, abs=500)
    assert linkage.apart(df.limit(0), df, 0) == {}


def test_hot_blocks_lose_no_pair(spark):
    """Records of one title without year or identifier, and years whose digits differ, meet as in a small block."""
    years = [None, "1999", "2000", "1850"]
    rows = [(str(k), "Poems", f"Author{k}, Jonas" if k % 3 else None, None if k % 2 else f"2090{k:06d}", years[k % 4]) for k in range(40)]
    df = spark.createDataFrame(rows, "key string, title string, author string, ident string, year string")
    _, n = linkage._prepared(df, "title", "author", "ident", F.col("year"))
    recs = [r["rec"] for r in n.collect()]
    for most in (1, 50, 10_000):
        pairs = [(r["l"], r["r"]) for r in linkage.candidate_pairs(n, n, max_pairs=most).collect()]
        assert sorted(pairs) == sorted((a, b) for a in recs for b in recs)


@pytest.mark.parametrize("value, form", [("2090-1234", "2090001234"), ("  2090123456", "2090123456"), ("2090123456/r97", "2090123456"), ("2090 12", "2090000012"), ("", None), (None, None), ("２０９０123456 ", "2090123456")])
def test_lccn(value, form):
    assert linkage.lccn(value) == form


# Leakage

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed, n_items, n_docs, change):
    """Items, and documents of which a third hold 20 words of an item, each word changed with the given chance."""
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(WORDS, k=60))) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        text = rng.choices(WORDS, k=rng.randrange(5, 120))
        if k % 3 == 0:
            item = items[rng.randrange(n_items)][1].split()
            at = rng.randrange(40)
            copied = [rng.choice(WORDS) if rng.random() < change else w for w in item[at : at + 20]]
            text[len(text) // 2 : len(text) // 2] = copied
        docs.append((k, " ".join(w.upper() if rng.random() < 0.2 else w for w in text).replace(" ", ", ", 3)))
    return items, docs


def brute_leaks(items, docs, window, most):
    out = set()
    for i, a in items:
        wa = leakage.words(a)
        for d, b in docs:
            wb = leakage.words(b)
            if any(leakage.edits(wa[x : x + window], wb[y : y + window], most) <= most for x in range(len(wa) - window + 1) for y in range(len(wb) - window + 1)):
                out.add((i, d))
    return out


def leaks(spark, items, docs, **how):
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    return {(r["item"], r["doc"]) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text", **how).collect()}


def test_exact_passages_are_all_found(spark, monkeypatch):
    items, docs = corpus(1, 6, 60, 0.03)
    docs += [(62, None), (63, ""), (64, "one two"), (0, docs[0][1]), (61, " ".join(WORDS * 50) + " " + items[0][1])]
    items += [(99, None), (98, "short"), items[0]]
    want = brute_leaks([x for x in items if x[1]], [x for x in docs if x[0] != 61], 12, 0) | {(0, 61)}
    assert leaks(spark, items, docs) == want
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 10)  # the shuffle join, for item sets too large to broadcast
    assert leaks(spark, items, docs) == want
    assert leaks(spark, [], docs) == leaks(spark, items, []) == set()


def test_near_passages_reach_the_recall(spark):
    items, docs = corpus(2, 5, 120, 0.06)
    want = brute_leaks(items, docs, 12, 1)
    got = leaks(spark, items, docs, max_edits=1)
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 20


@pytest.mark.parametrize("most", [1, 2])
def test_near_passages_of_every_length_reach_the_recall(spark, monkeypatch, most):
    """Passages of 12 to 24 words with 0 to `most` edits, on both paths: the recall holds at each length, not only on the whole."""
    rng = random.Random(most)
    items = [(k, " ".join(rng.choices(WORDS, k=40))) for k in range(4)]
    docs, length = [], {}
    for k, n in enumerate([12, 13, 14, 15, 17, 20, 24] * 60):
        ws = items[k % 4][1].split()
        at = rng.randrange(40 - n)
        copied = ws[at : at + n]
        for _ in range(k % (most + 1)):
            x = rng.randrange(len(copied))
            copied[x : x + 1] = rng.choice([["other"], [], [copied[x], "added"]])
        docs.append((k, " ".join(rng.choices(WORDS, k=k % 7) + copied + rng.choices(WORDS, k=9))))
        length[k] = n
    want = brute_leaks(items, docs, 12, most)
    same = brute_leaks(items, docs, 12, 0)
    for chars in (leakage.MAX_ITEM_CHARS, 10):
        monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", chars)
        got = leaks(spark, items, docs, max_edits=most)
        assert same <= got <= want
        for n in sorted(set(length.values())):
            due = {p for p in want if length[p[1]] == n}
            assert len(due) > 10 and len(due & got) >= 0.9 * len(due), (n, len(due), len(due & got))


def test_equal_windows_have_equal_walks():
    e = leakage.Embedding(12, 3, 2, 6)
    a = leakage._ids(WORDS[:12])
    b = leakage._ids(["x", "y", *WORDS[:12], "z"])
    both = list(zip(e.hashes(a, np.array([0])), e.hashes(b, np.array([2]))))
    assert len(both) == e.count == 6 and all(x[0] == y[0] for x, y in both)


# What the driver holds


def test_estimates_of_the_linkage_stay_small(spark, monkeypatch):
    """Rounds must not multiply Catalyst's size estimates, whose digits alone would fill the driver."""
    kept = []
    keep = lambda df: kept.append(variants_checkpoint(df)) or kept[-1]
    variants_checkpoint = variants.checkpoint
    monkeypatch.setattr(variants, "checkpoint", keep)
    edges = spark.createDataFrame([(i, j, 0.3 + 0.6 * i / 12) for i in range(12) for j in range(i + 1, min(i + 4, 12))], "a long, b long, sim double")
    variants.average_linkage(edges)
    assert len(kept) >= 5
    assert max(map(estimated_bytes, kept[:-1])) < 1 << 120  # the last one joins all the rounds' moves once


def test_what_grows_is_never_broadcast_by_estimate(spark, monkeypatch):
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    nodes = spark.createDataFrame([(i, f"{w} {v}") for i, (w, v) in enumerate([("anna", "meyer"), ("ana", "meyer"), ("otto", "meier")])], "node long, text string")
    assert text(variants.similar_texts(nodes)).count("SortMergeJoin") >= 4
    plans = []
    real = linkage.checkpoint
    monkeypatch.setattr(linkage, "checkpoint", lambda df: plans.append(text(df)) or real(df))
    rows = spark.createDataFrame([("a", "the night boat", "Ek, Ada", "2001000001", "2001")], "key string, title string, author string, ident string, year string")
    linkage.link(rows, rows)
    assert plans[-1].count("SortMergeJoin") >= 5
    assert "Inner, BuildLeft" not in plans[-1] and "Inner, BuildRight" not in plans[-1]
