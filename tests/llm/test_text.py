"""Consistent forms, canonical values, names, splitting and packing on hand-made and random texts."""

import os
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import canonical, consistent, names, packing, splitting, tokens

HAVE = os.path.exists(tokens.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not HAVE, reason="the tokenizer's vocabulary is not here")


# Consistent form


@pytest.mark.parametrize(
    "stored, form",
    [
        ("Ｔｈｅ ｅｎｄ", "The end"), ("café", "café"), ("Зеле­̈ный", "Зелёный"), ("ﬁsh ﬂood", "fish flood"), ("a b c　d\te", "a b c d e"), ("wаrehοuse", "warehouse"),
        ("​x﻿⁠y‍", "xy"), ("x̄", "x̄"), ("библиотeка", "библиотека"), ("Привет world", "Привет world"), ("“a” – b’s", "“a” – b’s"), ("ｶﾞ", "ガ"), ("", ""), ("신", "신"), ("ǆ", "dž"), ("a\nb", "a b"), ("한", "한"),
    ],
)
def test_consistent(stored, form):
    assert consistent.consistent(stored) == form


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_consistent_is_idempotent_and_composed(s):
    x = consistent.consistent(s)
    assert consistent.consistent(x) == x
    assert unicodedata.normalize("NFC", x) == x
    assert not any(unicodedata.category(c) in ("Cf", "Cc") or c.isspace() and c != " " for c in x)


def test_conflicts_of_the_mapping_are_found():
    t = consistent.transducer()
    assert t.tree["e"]["\u0301"][None] == "é" and t.tree["\u00a0"][None] == " "
    assert consistent.alike()["Greek", "Latin"]["ό"] == "ó" and consistent.alike()["Latin", "Cyrillic"]["ë"] == "ё"
    with pytest.raises(ValueError, match="becomes both"):
        consistent.Transducer([("ab", "x"), ("ab", "y")])
    with pytest.raises(ValueError, match="in turn"):
        consistent.Transducer([("\u0190", "\u0191"), ("\u0191", "z")])


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeoU각가\u0300\u0301\u0308\u0323\u0316\u031b\u0304\u0327< क\u093c\u09c7\u09be"), max_size=9))
def test_marks_in_any_order_compose(s):
    """The longest matches are the composition that the character database defines."""
    assert consistent.consistent(s) == unicodedata.normalize("NFC", s)


def test_inconsistent_rows(spark):
    df = spark.createDataFrame([("1", "ok", None), ("1", "ok", None), ("2", "a b", "x" * 100_000 + "​"), (None, "", "ﬁ"), ("3", "line\n", "q")], "id string, title string, author string").withColumn("field", F.lit("clash"))
    got = {(r["id"], r["field"]) for r in consistent.inconsistent(df, "id", ["title", "author"]).collect()}
    assert got == {("2", "title"), ("2", "author"), (None, "author"), ("3", "title")}
    assert consistent.inconsistent(df.limit(0), "id", ["title"]).count() == 0
    c = consistent.with_consistent(df, ["title", "author"])
    assert sorted(r["title"] for r in c.collect()) == ["", "a b", "line ", "ok", "ok"] and c.filter("author is null").count() == 2
    assert "ArrowEvalPython" in c._jdf.queryExecution().toString() and c.filter("title = 'ok'").count() == 2


# Canonical values

REF = [("basedon", "Based on", 9), ("editor", "Editor", 5), ("translatedas", "Translated as", 3), ("translationof", "Translation of", 4), ("radioadaptationof", "Radio adaptation of", 1), ("continuedby", "Continued by", 1), ("complementedby", "Complemented by", 1)]


@pytest.mark.parametrize(
    "value, key",
    [
        ("Based on", "basedon"), ("basedOn", "basedon"), ("BASED-ON (work)", "basedon"), ("see: based on", "basedon"), ("http://h/x/basedon/", "basedon"), ("ns1__basedon", "basedon"), ("basedon_INBOUND", "basedon"), ("baesd on", "basedon"),
        ("Adaptation of, radio", "radioadaptationof"), ("transl. as", "translatedas"), ("transl of", "translationof"), ("cont. by", "continuedby"), ("ed.", "editor"), ("gift copy", None), ("???", None), ("on loan (3)", None), ("n/a", None), ("x" * 5000, None),
    ],
)
def test_lookup(value, key):
    assert canonical.Dictionary(REF).lookup(value) == (key or canonical.UNMATCHED)


def exhaustive(entries, typed):
    """The best entry by distances to all of them."""
    near = [(got[1], -uses, k) for k, _, uses in entries if (got := canonical.distance(typed, k, min(canonical.allowed(len(typed)), canonical.allowed(len(k)))))]
    return min(near, default=None)


@pytest.mark.parametrize("operations", [1, 2, 3, 4])
def test_lookup_finds_what_brute_force_finds(operations):
    """Random deletions, insertions, substitutions and transpositions anywhere, also all near the beginning."""
    rng = np.random.default_rng(operations)
    entries = [*REF, ("containerof", "containerof", 5), ("adaptedasmotionpicture", "adaptedasmotionpicture", 3), ("operaadaptationof", "operaadaptationof", 9)]
    d = canonical.Dictionary([(k, k, n) for k, _, n in entries])
    n_found = 0
    for trial in range(400):
        s = list(entries[rng.integers(len(entries))][0])
        for _ in range(operations):
            k = int(rng.integers(1, min(6, len(s)) if trial % 2 else len(s)))
            what = rng.integers(4)
            if what == 0:
                del s[k]
            elif what == 1:
                s.insert(k, "q")
            elif what == 2:
                s[k] = "q"
            else:
                s[k - 1], s[k] = s[k], s[k - 1]
        typed = "".join(s)
        if typed in d.exact:
            continue
        assert d.near(typed) == exhaustive(entries, typed), typed
        n_found += d.near(typed) is not None
    assert n_found > 100


def test_weights():
    assert canonical.distance("basedom", "basedon", 3) < canonical.distance("basedoq", "basedon", 3)
    assert canonical.distance("bsaedon", "basedon", 3)[0] == 1
    assert canonical.distance("abc", "xyz", 1) is None


@pytest.mark.parametrize("most", [canonical.MAX_REFERENCE, 0])
def test_mapped_column(spark, monkeypatch, most):
    """By broadcast, and by the shuffle join that a large list takes."""
    monkeypatch.setattr(canonical, "MAX_REFERENCE", most)
    base = spark.createDataFrame([(k, label) for k, label, _ in REF] + [REF[0][:2], (None, "x")], "slug string, label string")
    ref = canonical.references(base, "slug", "label", spark.createDataFrame([("basedon", 5), ("zzz", 9)], "key string, n long"))
    df = spark.createDataFrame([(1, "Based on"), (2, None), (3, " "), (4, "junk"), (5, "Based on")], "n int, v string").withColumn("slug", F.lit("clash"))
    got = {r["n"]: r["key"] for r in canonical.map_values(df, "v", ref, "key").collect()}
    assert got == {1: "basedon", 2: None, 3: None, 4: canonical.UNMATCHED, 5: "basedon"}
    assert canonical.map_values(df.limit(0), "v", ref, "key").count() == 0
    assert {r["key"] for r in canonical.map_values(df, "v", ref.limit(0), "key").collect()} == {None, canonical.UNMATCHED}


def test_both_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    typed = ["transl. as", "transl of", "tr. as", "cont. by", "c. by", "ed.", "ba. on", "Adaptation of, radio", "see: basd on", "X" * 3000]
    for k, label, _ in REF * 8:
        s = list(label)
        for at in rng.integers(1, len(s) - 1, 3):
            s[at] = rng.choice(list("aeqz "))
        typed.append("".join(s))
    df = spark.createDataFrame([(v,) for v in typed], "v string")
    ref = spark.createDataFrame(REF, "key string, label string, n long")
    one = canonical.map_values(df, "v", ref, "key").collect()
    monkeypatch.setattr(canonical, "MAX_REFERENCE", 0)
    assert sorted(one) == sorted(canonical.map_values(df, "v", ref, "key").collect())
    assert 10 < sum(r["key"] != canonical.UNMATCHED for r in one) < len(typed)


def test_a_list_of_many_entries(spark):
    """Far more entries than are broadcast."""
    many = spark.range(210_000).select(F.concat(F.lit("k"), F.lpad(F.conv("id", 10, 26), 6, "0")).alias("key")).withColumns({"label": F.col("key"), "n": F.lit(0).cast("long")})
    df = spark.createDataFrame([("entry",), ("K00 0abc",)], "v string")
    ref = many.unionByName(spark.createDataFrame([("translationof", "Translation of", 3)], "key string, label string, n long"))
    got = {r["v"]: r["key"] for r in canonical.map_values(df.unionByName(spark.createDataFrame([("tarnslatonof",)], "v string")), "v", ref, "key").collect()}
    assert got == {"entry": canonical.UNMATCHED, "K00 0abc": "k000ABC", "tarnslatonof": "translationof"}


# Names


@pytest.mark.parametrize(
    "a, b, same",
    [
        (("Jordelbaunik, Francis", "1948-1984"), ("jordelbaunik, frank", None), True), (("Orbrehamisen, Henry, 1855-", None), ("Dr. Hal Orbrehamisen", "1855-1904"), True), (("Orbrehamisen Hal", None), ("Hal Orbrehamisen", None), True), (("Kelkaliruska, J.", None), ("Kelkaliruska, Johannes", None), True),
        (("Kelkaliruska, Odile", None), ("Kelkaliruska, Johannes", None), False), (("Kelkaliruska, Odile", "1800-1850"), ("Kelkaliruska, Odile", "1900-"), False), (("Inst. Applied Botany, Mebdun", None), ("Mebdun. Institute of Applied Botany", None), True),
        (("Institute of Applied Botany, Mebdun", None), ("Institute of Folk Music, Mebdun", None), False), (("Institute of Folk Music, Mebdun", None), ("Institute of Folk Music, Kalgar", None), False), (("A B", None), ("", None), False),
        (("Wenmor-Nalnis, Jonas", None), ("Jonas Wenmor", None), True),
    ],
)
def test_names_agree(a, b, same):
    x, y, fulls = names.readings(*a), names.readings(*b), {"frank": ("francis",), "hal": ("henry",)}
    assert (names.best_agreement(x, y, fulls) > 0) == same
    assert names.best_agreement(x, y, fulls) == names.best_agreement(y, x, fulls)


# Splitting


def check_pieces(text, vocabulary, limit, overlap):
    tok = tokens.tokenizer(vocabulary)
    p = splitting.pieces(text, vocabulary, limit, overlap)
    assert "".join(text[new:end] for _, new, end, _ in p) == text
    for k, (start, new, end, n) in enumerate(p):
        assert n == tok.count(text[start:end])
        assert n <= limit or end - new == 1
        if k:
            before = text[p[k - 1][0] : p[k - 1][2]]
            assert p[k - 1][2] == new and start <= new
            assert before.endswith(text[start:new])
            assert tok.count(text[start:new]) >= min(overlap, tok.count(before)) or tok.count(before) <= overlap
    return p


TEXTS = ["", " ", "word", "a b c. " * 400, "# One\n\n" + "Sentence here. " * 60 + "\n\n## Two\n\n- item\n- item two\n" * 20, "x" * 5000, "日本語の文章です。" * 300, "é́" * 900, "😀" * 700, "a;b;" * 900, "\n" * 3000, "Тихий дом. " * 500]


@pytest.mark.parametrize("k", range(len(TEXTS)))
@pytest.mark.parametrize("vocabulary", [tokens.PLAIN, pytest.param(tokens.VOCABULARY, marks=needs_vocabulary)])
def test_pieces(k, vocabulary):
    check_pieces(TEXTS[k], vocabulary, 128, 16)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "# Head\n", "- item\n", "\n\n", "Ende. ", "日本", "😀", "longlonglong", "1;2;", "\t"]), max_size=200).map("".join))
def test_pieces_of_random_texts(text):
    check_pieces(text, tokens.PLAIN, 40, 8)


def test_sections_are_kept_whole():
    text = "".join(f"# Head {k}\n\n" + "Words of a sentence. " * 15 + "\n\n" for k in range(8))
    p = splitting.pieces(text, tokens.PLAIN, 200, 20)
    assert len(p) > 1 and all(text[new:].startswith("# Head") for _, new, _, _ in p)


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "a b. " * 300), (1, "a b. " * 300), (2, None), (3, ""), (None, "x")], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    rows = splitting.split(df, "doc_id", "text", tokens.PLAIN, 64, 8).collect()
    assert {r["doc"] for r in rows} == {1, 3, None}
    assert sum(r["doc"] == 1 for r in rows) == 2 * len(splitting.pieces("a b. " * 300, tokens.PLAIN, 64, 8))
    assert splitting.split(df.limit(0), "doc_id", "text", tokens.PLAIN).count() == 0


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_pack_holds_everything(sizes):
    place = packing.pack(sizes, 100, 8)
    load = np.bincount(place, weights=sizes, minlength=1) if sizes else np.zeros(1)
    assert len(place) == len(sizes) and min(place, default=0) >= 0 and load.max() <= 100
    assert (max(place, default=-1) + 1) <= 2 * -(-sum(sizes) // 100) + 1


def test_pack_is_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5, 1, 4000).astype(int), 1, 1024).tolist()
    used = max(packing.pack(sizes)) + 1
    assert used <= 1.02 * -(-sum(sizes) // 1024)


def test_configurations_solve_the_program():
    """Three sizes whose best packing is known: 6 containers hold 6 of 50, 6 of 30 and 6 of 20."""
    out = packing.configurations(np.array([50, 30, 20]), np.array([6.0, 6.0, 6.0]), 100)
    assert sum(a for _, a in out) == pytest.approx(6.0)


@needs_vocabulary
def test_containers(spark):
    rows = [(k, "some words " * (k % 50)) for k in range(200)] + [(7, "some words " * 7), (1000, "long text " * 4000), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1))
    c = packing.containers(df, "doc_id", "text", shard=50).collect()
    assert len({(r["doc"], r["part"]) for r in c}) == len(c)
    load = {}
    for r in c:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    assert max(load.values()) <= 1024
    tok = tokens.tokenizer(tokens.VOCABULARY)
    held = {}
    for r in sorted(c, key=lambda r: (r["doc"], r["part"])):
        assert r["first_token"] == held.get(r["doc"], 0)
        held[r["doc"]] = held.get(r["doc"], 0) + r["tokens"]
    assert held == {d: n for d, t in rows if t and (n := tok.count(t))}
    assert packing.containers(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_texts_without_their_own_id_have_places(spark):
    long = "long text " * 4000
    rows = [(None, "red apple"), (None, "blue apple"), (5, "red apple"), (5, "blue apple"), (5, "blue apple"), (6, long), (6, long.replace("long", "other"))]
    tok = tokens.tokenizer(tokens.VOCABULARY)
    assert tok.count("red apple") == tok.count("blue apple") and tok.count(rows[5][1]) == tok.count(rows[6][1])
    c = packing.containers(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sum(r["tokens"] for r in c) == sum(tok.count(t) for _, t in set(rows))
    load = {}
    for r in c:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    assert max(load.values()) <= packing.CAPACITY


@needs_vocabulary
def test_token_ends_match_the_encoding():
    tok = tokens.tokenizer(tokens.VOCABULARY)
    for text in TEXTS:
        ends = tok.ends(text)
        assert len(ends) == tok.count(text) and (not len(ends) or ends[-1] == len(text)) and (np.diff(ends) >= 0).all()
