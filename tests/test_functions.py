"""Scalar functions against values worked out by hand."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave import dims
from kinweave.config import Config, http_endpoint, truthy
from kinweave.functions import exprs as X
from kinweave.functions import uris

C = Config()


def values(spark, expr, *rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_dimensions_are_complete_and_disjoint():
    assert len(dims.TIER_OF) == len(dims.RELATION_TYPES) == 119
    assert len(dims.LABEL_OF) == 62
    assert len(dims.INLINE_TYPE) == len(dims.INLINE_LABELS) == 37


def test_bare_slug(spark):
    got = values(spark, uris.bare_slug(F.col("x")), " http://id.catalog.example/entities/relationships/Inseries_INBOUND ", "ns1__PartOf", "", " ", None, "a/b", "http://h/x/containerof/", "x\u00a0")
    assert got == ["inseries", "partof", None, None, None, "a/b", "containerof", "x"]


def test_hub_key(spark):
    ok = ["http://H.example/resources/hubs/a1", "https://h.example/resources/hubs/a1/", " http://h.EXAMPLE/resources/hubs/a1.rdf", "http://h.example/resources/hubs/a1#hub", "http://h.example/resources/hubs/a1.json/", "http://h.example/resources/hubs/a1.html?x=1"]
    assert set(values(spark, uris.hub_key(F.col("x")), *ok)) == {"h.example/resources/hubs/a1"}
    no = ["http://h.example/resources/works/1", "", None, "not a uri", "http://h.example/resources/hubs/", "ftp://h.example/resources/hubs/1"]
    assert values(spark, uris.hub_key(F.col("x")), *no) == [None] * 6


def test_labels_and_tiers(spark):
    slugs = ["sequel", "sequel_INBOUND", "ns0__translationOf", "relatedto", "relatedwork", "partof", "basedon"]
    assert values(spark, X.label(F.col("x")), *slugs) == ["Sequel", "Sequel", "Translation", "Relatedto", "Relatedwork", "Part", "Based On"]
    assert values(spark, X.tier(F.col("x")), "parodyof", "SEQUEL", "relatedwork", "related", "arrangementof", "libretto") == [1, 3, 3, 5, 3, 3]


def test_base_label_takes_the_first_rule_that_changes(spark):
    rows = ["X. Hamlet. Russian", "X. Hamlet", "A. Carmen. Selections. French", "X, 1564-1616. Hamlet. Act 2, scene 1", "X. The work (Motion picture)", "Hamlet", "X. Songs. French & German"]
    assert values(spark, X.base_label(F.col("x")), *rows) == ["X. Hamlet", "X", "A. Carmen French", "X, 1564-1616. Hamlet", "X. The work", "Hamlet", "X. Songs"]


def test_text_functions(spark):
    assert values(spark, X.strip_article(F.col("x")), " The Tempest", "An apple", "Another", "a  b") == ["Tempest", "apple", "Another", "b"]
    assert values(spark, X.trim_punctuation(F.col("x")), "Hamlet /", "a;:,. ", "", None) == ["Hamlet", "a", "", None]
    assert values(spark, X.percent_encode(F.col("x")), "a b*~é") == ["a%20b%2A~%C3%A9"]
    assert values(spark, X.rdf_url(F.col("x")), "http://h/x/", "https://h/x.rdf") == ["https://h/x.rdf", "https://h/x.rdf"]
    assert values(spark, X.validation_url(F.col("x"), C), f"http://{C.host}/a", f"http://{C.host}/a.TTL", "http://other/a") == [f"http://{C.host}/a.rdf", f"http://{C.host}/a.TTL", "http://other/a"]
    assert values(spark, X.basename(F.col("x")), "http://h/a/b", "http://h/a/b/", "b") == ["b", "b", "b"]


def test_author_and_medium(spark):
    schema = "s array<string>, t array<string>"
    pairs = [(["a"], ["b"]), (["a"], ["a", "b"]), (["a"], ["a"]), ([], ["a"]), (None, None)]
    assert values(spark, X.author_bonus(F.col("s"), F.col("t")), *pairs, schema=schema) == [15.0, 8.0, 0.0, 5.0, 5.0]
    assert values(spark, X.different_author(F.col("s"), F.col("t")), *pairs, schema=schema) == [True, False, False, False, False]
    generic = list(C.generic_media)
    media = [(["x"], ["y"]), (generic, ["y"]), (["x"], generic), (["x"], ["x", "y"]), (None, [])]
    expr = X.medium_bonus(X.specific_media(F.col("s"), C), X.specific_media(F.col("t"), C))
    assert values(spark, expr, *media, schema=schema) == [10.0, 8.0, 3.0, 0.0, 0.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6)), min_size=1, max_size=20))
def test_rarity_is_between_0_and_10(spark, pairs):
    rows = [(min(p), max(p)) for p in pairs]
    for (f, m), x in zip(rows, values(spark, X.rarity_bonus(F.col("f"), F.col("m")), *rows, schema="f long, m long")):
        assert 0 <= x <= 10
        assert x == pytest.approx(5.0 if f == 0 or m == 0 else 10 * (1 - math.log10(f + 1) / math.log10(m + 1)))


def test_config(tmp_path):
    ini = tmp_path / "a.ini"
    ini.write_text("[Connection]\ntimeout = 3\n[Display]\nvalidateUris = false\nmaxDisplayResults = 4\n")
    c = Config.from_ini(str(ini))
    assert (c.timeout, c.validate_uris, c.max_display, c.frequency_ttl) == (3, False, 4, 86_400)
    assert http_endpoint("bolt://localhost:7687") == "http://localhost:7474"
    assert http_endpoint("bolt+s://db:7687") == "https://db:7474"
    assert truthy("no") and not truthy("false") and not truthy(False)
