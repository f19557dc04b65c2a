"""Nested records, orphan references, MARC and RDF on hand-made cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.operators import nested, orphans
from kinweave.operators import resolve as R
from kinweave.sources import marc, rdfxml, triples

C = Config()
XML = '<m:record xmlns:m="urn:x"><m:leader>L</m:leader><m:controlfield tag="001">1</m:controlfield><m:datafield tag="500" ind1=" " ind2=" "/><m:datafield tag="700" ind1="1" ind2=" "><m:subfield code="a"/><m:subfield code="e">b &amp; c</m:subfield></m:datafield></m:record>'
JSON = '{"leader": "L", "fields": [{"001": "1"}, {"500": {"ind1": " ", "ind2": " ", "subfields": []}}, {"700": {"ind1": "1", "ind2": " ", "subfields": [{"a": ""}, {"e": "b & c"}]}}]}'


def found(spark, *rows, extra=False):
    df = spark.createDataFrame(list(rows), "id string, fullrecord string")
    if extra:
        df = df.withColumns({c: F.lit(1) for c in ("tag", "pk", "payload", "key")})
    t = nested.table(nested.flatten(df), "subfield")
    return sorted(t.select("id", "field_seq", "tag", "sub_seq", "code", "value").distinct().collect())


def test_xml_and_json_give_the_same_tables(spark):
    want = [("x", 2, "700", 1, "a", ""), ("x", 2, "700", 2, "e", "b & c")]
    assert [tuple(r) for r in found(spark, ("x", XML))] == [tuple(r) for r in found(spark, ("x", JSON))] == want
    assert [tuple(r) for r in found(spark, ("x", XML), ("x", XML), extra=True)] == want


def test_bad_records_give_nothing(spark):
    bad = [None, "", " ", "<record>", XML[:-5], JSON[:-4], "{}", "[]", "3", '{"fields": 4}', "plain text", XML.replace("b &amp; c", "b & c")]
    assert found(spark, *[(str(k), b) for k, b in enumerate(bad)]) == []
    assert found(spark) == []


def test_every_row_leads_to_its_parent(spark, tmp_path):
    df = spark.createDataFrame([("x", XML), ("y", JSON), (None, JSON)], "id string, fullrecord string")
    path = str(tmp_path / "t")
    nested.write_tables(nested.flatten(df), path)
    rec, field, sub = (nested.read_table(spark, path, t) for t in ("record", "field", "subfield"))
    assert (rec.count(), field.count(), sub.count()) == (3, 6, 6)
    assert field.join(rec.select(F.col("pk").alias("parent_pk")), "parent_pk", "left_anti").count() == 0
    assert sub.join(field.select(F.col("pk").alias("parent_pk")), "parent_pk", "left_anti").count() == 0
    assert sum(r["n_subfields"] for r in field.collect()) == sub.count()


def test_long_record(spark):
    one = '<datafield tag="9"><subfield code="a">x</subfield></datafield>'
    assert len(found(spark, ("x", f"<record>{one * 30_000}</record>"))) == 30_000


H = "http://h.example/resources/hubs/"
T = [datetime(2024, m, 1) for m in range(1, 7)]


def hubs(spark):
    return orphans.lifetimes(spark.createDataFrame([(f"{H}a", T[1], T[3]), (f"{H}b", None, None), (f"{H}c", T[2], None), (f"{H}c", T[2], None), (None, T[0], None)], "hub_uri string, created_at timestamp, deleted_at timestamp"))


def refs(spark, rows):
    df = spark.createDataFrame(rows, "n long, uri string, t timestamp").withColumn("key", F.lit("clash")).withColumn("period", F.lit(1))
    return orphans.references(df, "t", "n", "uri", "t")


CASES = [
    (1, f"{H}a", T[0]), (2, f"{H}a/", T[1]), (3, f"{H}a.rdf", T[3]), (4, f"{H}a", T[5]), (5, f"{H}b", T[0]), (6, f"{H}zz", T[2]), (7, f"{H}c#x", T[1]), (8, f"{H}c", T[2]), (9, None, T[0]), (10, "", T[0]),
    (11, "http://h.example/resources/works/1", T[0]), (12, f"{H}zz", None), (13, f"{H}a", None), (6, f"{H}zz", T[2]),
]
WANT = {(1, "late"), (3, "deleted"), (4, "deleted"), (6, "missing"), (7, "late"), (12, "missing")}


@pytest.mark.parametrize("heavy", [[], ["h.example/resources/hubs/a", "h.example/resources/hubs/zz"], None])
def test_orphans_by_either_path(spark, heavy):
    rows = orphans.orphan_rows(refs(spark, CASES), hubs(spark), heavy).collect()
    assert len(rows) == len(WANT) and {(r["row_id"], r["reason"]) for r in rows} == WANT
    assert {r["row_id"]: r["period"] for r in rows}[12] is None and {r["row_id"]: r["period"] for r in rows}[6] == "2024-03"
    keys = orphans.orphan_keys(refs(spark, CASES), hubs(spark), heavy).collect()
    assert {(r["period"], r["orphan_keys"], r["orphan_refs"]) for r in keys} == {("2024-03", 1, 2), (None, 1, 1)}


def test_orphans_of_empty_tables(spark):
    assert orphans.orphan_rows(refs(spark, []), hubs(spark)).count() == 0
    none = orphans.lifetimes(spark.createDataFrame([], "hub_uri string, created_at timestamp, deleted_at timestamp"))
    assert {r["reason"] for r in orphans.orphan_rows(refs(spark, CASES), none).collect()} == {"missing"}


def test_heavy_keys_are_found(spark):
    r = refs(spark, [(k, f"{H}hot", T[0]) for k in range(300)] + [(k, f"{H}{k}", T[0]) for k in range(300, 600)])
    assert orphans.heavy_keys(orphans._counted(r)) == ["h.example/resources/hubs/hot"]
    assert orphans.heavy_keys(orphans._counted(r.limit(0))) == []
    a = orphans.orphan_rows(r, hubs(spark)).collect()
    assert sorted(a) == sorted(orphans.orphan_rows(r, hubs(spark), []).collect()) and len(a) == 600


# MARC

FIELDS = [
    ("130", "1", "http://other.example/1"), ("240", "0", f"http://{C.host}/resources/hubs/u"), ("758", "i", "HAS EXPRESSION MANIFESTED :"), ("758", "0", "http://x"), ("758", "1", f"https://{C.host}/resources/hubs/v"),
]


def record(fields, control="<controlfield tag='001'>7</controlfield>"):
    body = "".join(f"<datafield tag='{t}' ind1=' ' ind2=' '>{''.join(f'<subfield code={chr(39)}{c}{chr(39)}>{v}</subfield>' for c, v in subs)}</datafield>" for t, subs in fields)
    return f"<record>{control}{body}</record>"


def as_marc(spark, *xml):
    return spark.createDataFrame([(x,) for x in xml], "x string").select(marc.from_column(F.col("x")).alias("marc"))


def test_hub_uri_and_self_hub(spark):
    xml = record([("240", [("1", "http://no"), ("0", f"http://{C.host}/resources/hubs/u")]), ("758", [("i", "HAS EXPRESSION MANIFESTED :"), ("0", "http://x"), ("1", f"https://{C.host}/resources/hubs/v")]), ("758", [("a", "only a label")])])
    df = as_marc(spark, xml).select(R.first_hub_uri(F.col("marc"), "240", C).alias("h"), R.work_relations(F.col("marc"), C).alias("w"))
    r = df.select("h", R.self_hub(F.col("w")).alias("s"), F.size("w").alias("n"), F.get("w", F.lit(0))["relLabel"].alias("l"), F.get("w", F.lit(0))["authUri"].alias("a")).first()
    assert tuple(r) == (f"http://{C.host}/resources/hubs/u", f"https://{C.host}/resources/hubs/v", 1, "HAS EXPRESSION MANIFESTED", "http://x")


def test_index_document_rules(spark):
    rows = [
        record([("245", [("a", "T /")]), ("264", [("c", "no digits")]), ("260", [("c", "1901")])]),
        record([("260", [("c", "c1902.")]), ("110", [("a", "Body ,")])]),
        record([("245", [("a", "Gone")])], control=""),
    ]
    docs = {r["title"]: r for r in marc.index_document(as_marc(spark, *rows), "p").collect()}
    assert set(docs) == {"T", "[Untitled]"} and docs["T"]["publishDate"] is None
    assert docs["[Untitled]"]["publishDate"] == ["1902"] and docs["[Untitled]"]["author"] == "Body"
    assert tuple(marc.load_totals(as_marc(spark, *rows)).first()) == (2, 1)


def test_marc_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<collection xmlns='urn:m'>" + record([("245", [("a", "One")])]) + record([("245", [("a", "Two")])]) + "</collection>")
    assert {r["title"] for r in marc.index_document(marc.read_files(spark, str(tmp_path / "a.xml")), "f").collect()} == {"One", "Two"}


# RDF

NS = f'xmlns:r="{rdfxml.RDF}" xmlns:b="{C.ontology}" xmlns:s="{rdfxml.RDFS}"'
HUB = f"http://{C.host}/resources/hubs/"


def rel(kind, target="t", inner=""):
    return f'<b:relation><b:Relation><b:relationship>{kind}</b:relationship><b:associatedResource><b:Hub r:about="{HUB}{target}">{inner}</b:Hub></b:associatedResource></b:Relation></b:relation>'


def kind(about="", label=""):
    return f'<b:Relationship{f" r:about={chr(34)}{about}{chr(34)}" if about else ""}>{f"<s:label>{label}</s:label>" if label else ""}</b:Relationship>'


def parsed(body, uri="u"):
    return rdfxml.Parser(C).parse(uri, body)


def work(inner):
    return f'<r:RDF {NS}><b:Work r:about="u">{inner}</b:Work></r:RDF>'


@pytest.mark.parametrize(
    "xml, want",
    [
        (kind(f"http://{C.host}/entities/relationships/Parodyof", "Sequel (work)"), "parodyof"), (kind(f"http://{C.host}/vocabulary/relationship/partof", "Sequel (work)"), "sequel"), (kind(label="related work"), "relatedwork"),
        (kind(label="Retold in (expression)"), "retoldin"), (kind(f"http://{C.host}/vocabulary/relationship/sequel"), "relatedwork"), (kind(f"http://{C.host}/vocabulary/relationship/relatedwork") + kind(label="Set in (work)"), "setin"), ("", "relatedwork"),
    ],
)
def test_relation_types(xml, want):
    assert parsed(work(rel(xml)))[4][0][1] == want


def test_rdf_structure():
    body = work(
        f'<b:title><b:Title><b:mainTitle> Own </b:mainTitle></b:Title></b:title><r:type r:resource="{C.ontology}Text"/><b:contribution><b:Contribution><b:agent><b:Agent r:about="a1"/></b:agent><b:agent><b:Person r:about="p"/></b:agent></b:Contribution></b:contribution>'
        + rel(kind(), "x", rel(kind(), "nested")) + '<b:translationOf r:resource="http://else/1"/><b:relatedTo/>'
    )
    uri, title, agents, media, relations = parsed(body)
    assert (title, agents, media) == ("Own", ["a1"], [f"{C.ontology}Text"])
    assert [r[0].rsplit("/", 1)[1] for r in relations] == ["x", "nested", "1"] and relations[2][1:] == ("translationof", None, True)
    assert parsed("<broken") is None and parsed("") is None and parsed(None) is None
    assert len(parsed(f"<r:RDF {NS}>{rel(kind())}</r:RDF>")[4]) == 1  # without a work the whole document is searched


def test_one_relation_per_target():
    rows = [("t", "relatedwork", None, False), ("t", "relatedto", None, False), ("t", "sequel", None, False), ("u", "relatedwork", None, False)]
    assert [r[1] for r in rdfxml.one_per_target(rows)] == ["relatedto", "relatedwork"]


def test_payloads(spark):
    rows = [("u", 200, "application/rdf+xml", work(rel(kind()))), ("v", 200, "text/HTML", "<x/>"), ("w", 200, "x", " <!DOCTYPE html>"), ("x", 404, "x", "<x/>"), ("y", 200, "x", ""), ("z", 200, None, "<broken")]
    p = rdfxml.parse(rdfxml.usable(spark.createDataFrame(rows, "hub_uri string, http_status int, content_type string, body string")))
    assert [r["uri"] for r in p.collect()] == ["u"]


def test_turtle_and_ntriples(spark, tmp_path):
    bf = C.ontology
    ttl = f"""@prefix bf: <{bf}> . @prefix : <http://e/> . # comment
    <http://e/h1> a bf:Hub ; bf:title [ a bf:Title ; bf:mainTitle "A \\"b\\"", "C"@en ] ; bf:relation _:r1 .
    _:r1 bf:relationship <http://v/bad uri> .
    _:r1 bf:associatedResource :h2 ; bf:n 4.5 . :h2 a bf:Hub ."""
    (tmp_path / "a.ttl").write_text(ttl)
    for end in (" .\n", None):
        got = [(r["s"], r["p"], r["o"]) for r in triples.read_turtle(spark, str(tmp_path / "a.ttl"), end).collect()]
        by = {(p, o): s for s, p, o in got}
        r1 = next(o for s, p, o in got if p == f"{bf}relation")
        assert r1.startswith("bnode://") and r1.endswith("r1") and by[f"{bf}associatedResource", "http://e/h2"] == r1 == by[f"{bf}n", "4.5"]
        assert by[f"{bf}mainTitle", 'A "b"'] == by[f"{bf}mainTitle", "C"] == next(o for s, p, o in got if p == f"{bf}title")
        assert sum(p == triples.RDF_TYPE for _, p, _ in got) == 3
    nt = f'<http://e/h1> <{triples.RDF_TYPE}> <{bf}Hub> .\n<http://e/h2> <{triples.RDF_TYPE}> <{bf}Hub> .\n<http://e/h1> <{bf}relation> _:r .\n_:r <{bf}associatedResource> <http://e/h2> .\n<http://e/h1> <{bf}title> _:t .\n_:t <{bf}mainTitle> "T \\"x\\""@en .\nbroken\n<http://e/h3> <{bf}note> <bad uri> .\n'
    (tmp_path / "a.nt").write_text(nt)
    df = triples.read_ntriples(spark, str(tmp_path / "a.nt"))
    assert df.count() == 7
    g = triples.to_graph(df)
    rel = g.relation.collect()
    assert [tuple(r)[1:] for r in rel] == [("http://e/h1", "http://e/h2")] and rel[0][0].startswith("bnode://") and g.hub.count() == 2
    assert g.title.first()["main_titles"] == ['T "x"']


def test_blank_nodes_of_two_files_differ(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.ttl").write_text("@prefix e: <http://e/> .\n<http://e/%s> e:p [ e:q 1 ] .\n<http://e/%s> e:r _:x .\n_:x e:s 2 .\n" % (name, name))
        (tmp_path / f"{name}.nt").write_text(f"<http://e/{name}> <http://e/r> _:x .\n_:x <http://e/s> \"2\" .\n")
    for df in (triples.read_turtle(spark, str(tmp_path / "*.ttl")), triples.read_turtle(spark, str(tmp_path / "*.ttl"), None)):
        got = df.collect()
        assert len({r["o"] for r in got if r["p"] in ("http://e/p", "http://e/r")}) == 4
        assert {r["s"] for r in got if r["p"] == "http://e/s"} == {r["o"] for r in got if r["p"] == "http://e/r"}
        assert {r["s"] for r in got if r["p"] == "http://e/q"} == {r["o"] for r in got if r["p"] == "http://e/p"}
    assert len({r["s"] for r in triples.read_ntriples(spark, str(tmp_path / "*.nt")).filter("p = 'http://e/s'").collect()}) == 2


def test_a_large_file_is_split(spark, tmp_path):
    body = "".join(f"<http://e/{k}> e:n {k} ;\n  e:t \"T{k}.\" .\n" for k in range(4000))
    (tmp_path / "big.ttl").write_text(f"@prefix e: <http://e/> .\n{body}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = triples.read_turtle(spark, str(tmp_path / "big.ttl"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 8000
        assert {tuple(r)[:3] for r in df.collect()} == {x for k in range(4000) for x in ((f"http://e/{k}", "http://e/n", str(k)), (f"http://e/{k}", "http://e/t", f"T{k}."))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_escapes_are_undone_once(spark, tmp_path):
    written = r"a\\tb \t \u00e9 \U0001F600 \" \\\\ \\u0041"
    want = "a\\tb \t é 😀 \" \\\\ \\u0041"
    (tmp_path / "e.nt").write_text(f'<http://e/s> <http://e/p> "{written}" .\n', encoding="utf-8")
    (tmp_path / "e.ttl").write_text(f'<http://e/s> <http://e/p> "{written}" .\n', encoding="utf-8")
    assert triples.read_ntriples(spark, str(tmp_path / "e.nt")).first()["o"] == want
    assert triples.read_turtle(spark, str(tmp_path / "e.ttl")).first()["o"] == want


def test_collections_and_long_strings():
    got = list(triples.turtle("@prefix e: <http://e/> . e:s e:p (1 e:o) , () ; e:q '''it's\n. long''' ."))
    nodes = [t[0] for t in got if t[1] == triples.RDF_FIRST]
    assert [t[2] for t in got if t[1] == triples.RDF_FIRST] == ["1", "http://e/o"] and len(set(nodes)) == 2
    assert ("http://e/s", "http://e/p", triples.RDF_NIL, True, None) in got and ("http://e/s", "http://e/q", "it's\n. long", False, None) in got
    assert ("http://e/s", "http://e/p", nodes[0], True, None) in got and (nodes[1], triples.RDF_REST, triples.RDF_NIL, True, None) in got
