"""Queries of validation, text functions, resolution, MARC, RDF and the older model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.functions import exprs as X
from kinweave.model import Graph
from kinweave.operators import graph as G
from kinweave.operators import legacy as L
from kinweave.operators import resolve as R
from kinweave.operators import scoring as S
from kinweave.operators import validation as V
from kinweave.plans import graph_sql as Q
from kinweave.plans import related as P
from kinweave.plans.graph_queries import _scored
from kinweave.session import checkpoint, read
from kinweave.sources import fixture, marc, rdfxml

_C = Config()
_DAY = 86_400
_H = f"http://{_C.host}/resources/hubs/"
_VOC, _ENT = _C.relationship_prefixes


# Validation


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    e = read(spark, d, "events")
    log = e.select(fixture.hub_uri(F.col("user_id"), _C).alias("uri"), (F.col("event_type") != "error").alias("valid"), F.col("ts").cast("timestamp").alias("checked_at"))
    return log, e.agg(F.max("ts").cast("timestamp")).scalar()


def validation_latest(spark: SparkSession, d: str) -> DataFrame:
    log, as_of = _log(spark, d)
    return V.latest(log).select("uri", "valid", F.unix_micros("checked_at").alias("checked_us"), X.fresh(F.col("checked_at"), as_of, _DAY).alias("fresh"))


def needs_check_anti(spark: SparkSession, d: str) -> DataFrame:
    log, as_of = _log(spark, d)
    return V.need_check(fixture.graph(spark, d).relation.select(F.col("target_uri").alias("uri")), log, as_of, _DAY)


def validated_semi(spark: SparkSession, d: str) -> DataFrame:
    log, as_of = _log(spark, d)
    return V.valid_uris(log, as_of, _DAY)


def validate_window_cap(spark: SparkSession, d: str) -> DataFrame:
    log, as_of = _log(spark, d)
    return V.shown(S.ranked(_scored(spark, d)), V.valid_uris(log, as_of, _DAY)).select("source_uri", "target_uri", "rank", "shown_rank")


def negative_cache_skip(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("event_type = 'signup'")
    negative = e.select(fixture.hub_uri(F.col("user_id"), _C).alias("uri"), F.col("ts").cast("timestamp").alias("checked_at"))
    return V.skip_known_empty(fixture.graph(spark, d).hub, negative, _log(spark, d)[1], _DAY)


def validation_urls(spark: SparkSession, d: str) -> DataFrame:
    t = fixture.graph(spark, d).relation.select(F.col("target_uri").alias("uri")).distinct()
    return t.select("uri", X.validation_url(F.col("uri"), _C).alias("checked"), X.rdf_url(F.col("uri")).alias("rdf"), X.basename(F.col("uri")).alias("name"), X.url_path(F.col("uri")).alias("path"), X.is_hub(F.col("uri"), _C).alias("is_hub"))


# Text


def _titles(spark: SparkSession, d: str) -> DataFrame:
    article = F.when(F.col("p_size") % 3 == 0, "The ").when(F.col("p_size") % 3 == 1, "A ").otherwise("")
    tail = F.when(F.col("p_size") % 4 == 0, " /").when(F.col("p_size") % 4 == 1, ".").when(F.col("p_size") % 4 == 2, " :").otherwise("")
    return read(spark, d, "part").select("p_partkey", F.concat(article, "p_name", tail).alias("title"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """`hub_uri, label, author, title`: access points of the parts with the suppliers of all their order lines."""
    li = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p, s = read(spark, d, "part"), read(spark, d, "supplier")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    tail = F.element_at(F.array(*map(F.lit, ("", ". Russian", ". Selections", " (Motion picture)", ". Act 2"))), F.col("p_size") % 5 + 1)
    title = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2)))
    return j.select(fixture.hub_uri(F.col("p_partkey"), _C).alias("hub_uri"), F.concat(X.access_point(F.col("s_name"), title), tail).alias("label"), F.col("s_name").alias("author"), title.alias("title"), "p_size")


def strip_article(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("p_partkey", X.strip_article(F.col("title")).alias("title"), F.size(X.words(X.strip_article(F.col("title")))).alias("n_words"))


def trim_punct(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("p_partkey", X.trim_punctuation(F.col("title")).alias("title"))


def access_point(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("hub_uri", X.access_point(F.col("author"), F.col("title")).alias("access_point"))


def base_label(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("label", X.base_label(F.col("label")).alias("base")).distinct()


def percent_encode(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("label", X.percent_encode(F.col("label")).alias("path"), X.query_encode(F.col("label")).alias("query")).distinct()


# Resolution


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select(F.col("p_partkey").alias("id"), X.trim_punctuation(F.col("title")).alias("title"))


def title_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct title searched in all titles."""
    q = _asked(spark, d).select(X.strip_article(F.col("title")).alias("title")).distinct().select(F.col("title").alias("id"), "title")
    return R.title_search(q, fixture.graph(spark, d)).select("id", "hub_uri", F.round("relevance", 6).alias("relevance"))


def hub_by_title(spark: SparkSession, d: str) -> DataFrame:
    g = fixture.graph(spark, d)
    q = _asked(spark, d).select(X.strip_article(F.col("title")).alias("title")).distinct().select(F.col("title").alias("id"), "title")
    return R.by_title(q, g, G.degrees(g))


def lccn_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("lccn"))
    return R.by_lccn(r, fixture.graph(spark, d))


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    r = p.select(
        key.alias("id"), F.when(size % 4 == 0, fixture.hub_uri(key, _C)).alias("hub_uri"), F.when(size % 4 == 1, F.lpad(key.cast("string"), 10, "0")).alias("lccn"),
        F.when(size % 4 == 2, F.col("p_name")).otherwise(F.lit("")).alias("title"), F.lit(None).cast("string").alias("uniform_title"),
    )
    g = fixture.graph(spark, d)
    return R.cascade(r, g, G.degrees(g))


def label_strategy(spark: SparkSession, d: str) -> DataFrame:
    """How often each strategy finds a hub."""
    lab = _labels(spark, d)
    size = F.col("p_size")
    records = lab.select(
        F.concat_ws("|", "hub_uri", "author").alias("id"), "author",
        F.when(size % 5 == 0, F.col("title")).when(size % 5 == 1, F.concat("author", F.lit(". "), "title", F.lit(". Russian"))).alias("uniform_title"), F.when(size % 2 == 0, F.col("title")).alias("title"),
    ).distinct()
    known = lab.select("label", "hub_uri").distinct()
    hits = known.select(F.col("hub_uri").alias("uri"), F.col("label").alias("aLabel"))
    found = R.label_cascade(records, known, lambda q: R.suggest_search(q, hits, 1))
    return found.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_records"), F.count("hub_uri").alias("n_found"))


def base_work(spark: SparkSession, d: str) -> DataFrame:
    lab = _labels(spark, d)
    return R.base_work(lab.select(F.col("label").alias("id"), F.col("label").alias("aLabel")).distinct(), lab.select("label", "hub_uri"))


def verify_lccn(spark: SparkSession, d: str) -> DataFrame:
    """Hits as JSON with one identifier each, against the record's number or its neighbour's."""
    p = read(spark, d, "part")
    n = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    hit = F.concat(F.lit('{"hits":[{"uri":"'), fixture.hub_uri(F.col("p_partkey"), _C), F.lit('","more":{"identifiers":["'), F.substring(n, 1, 4), F.lit(" "), F.substring(n, 5, 6), F.lit('"]}}]}'))
    hits = F.from_json(hit, "hits array<struct<uri string, more struct<identifiers array<string>>>>")["hits"]
    want = F.when(F.col("p_size") % 2 == 0, n).otherwise(F.lpad((F.col("p_partkey") + 1).cast("string"), 10, "0"))
    return p.select(F.col("p_partkey").alias("id"), R.verified(hits, want).alias("verified"))


# MARC: records written as XML from columns and read back


def _marc_xml() -> Column:
    key, size = F.col("p_partkey"), F.col("p_size")

    def sub(code: str, v: Column) -> Column:
        return F.concat(F.lit(f'<subfield code="{code}">'), v, F.lit("</subfield>"))

    def field(tag: str, *subs: Column) -> Column:
        return F.concat(F.lit(f'<datafield tag="{tag}" ind1=" " ind2=" ">'), *subs, F.lit("</datafield>"))

    def some(test: Column, x: Column) -> Column:
        return F.when(test, x).otherwise(F.lit(""))

    hub = fixture.hub_uri(key, _C)
    rel = F.when(size % 3 == 0, "Has work manifested: ").when(size % 3 == 1, "Expression of :").otherwise("Sequel :")
    return F.concat(
        F.lit('<record xmlns="http://example.org/slim"><leader>00000nam</leader>'),
        some(size % 9 != 0, F.concat(F.lit('<controlfield tag="001">'), key.cast("string"), F.lit("</controlfield>"))),
        F.lit('<controlfield tag="008">'), F.rpad(F.lit(""), 35, "#"), F.when(size % 2 == 0, "eng").otherwise("fre"), F.lit(" d</controlfield>"),
        some(size % 4 == 0, field("010", sub("a", F.concat(F.lit("  "), F.lpad(key.cast("string"), 10, "0"))))),
        some(size % 5 != 0, field("100", sub("a", F.concat("p_brand", F.lit(" ,"))))), some(size % 5 == 0, field("110", sub("a", F.concat("p_type", F.lit(","))))),
        some(size % 6 == 0, field("240", sub("a", F.concat("p_name", F.lit("."))), sub("1", F.concat(F.lit("http://example.org/x/"), key.cast("string"))), sub("0", hub))),
        field("245", sub("a", F.concat("p_name", F.lit(" :"))), some(size % 2 == 0, sub("b", F.concat("p_type", F.lit(" /"))))),
        some(size % 7 != 0, field("264", sub("c", F.concat(F.lit("c"), (1900 + size).cast("string"), F.lit("."))))), some(size % 7 < 3, field("260", sub("c", F.lit("[1850]")))),
        field("758", sub("i", rel), sub("a", F.concat("p_name", F.lit(" /"))), some(size % 8 != 0, sub("1", hub)), sub("4", F.lit(f"{_VOC}sequel"))), F.lit("</record>"),
    )


def _marc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", marc.from_column(_marc_xml()).alias("marc"))


def marc_index_doc(spark: SparkSession, d: str) -> DataFrame:
    doc = marc.index_document(_marc(spark, d), "show")
    return doc.select("id", "title", "title_sort", "author", F.get("language", F.lit(0)).alias("lang"), F.get("publishDate", F.lit(0)).alias("date"), "record_format")


def marc_totals(spark: SparkSession, d: str) -> DataFrame:
    return marc.load_totals(_marc(spark, d))


def marc_not_loaded(spark: SparkSession, d: str) -> DataFrame:
    docs = marc.index_document(_marc(spark, d), "show").select("id")
    have = read(spark, d, "part").filter("p_size < 25").select(F.concat(F.lit("show-"), "p_partkey").alias("id"))
    return marc.not_loaded(docs, have)


def _fields(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    m = _marc(spark, d).select(F.col("p_partkey").alias("id"), none.alias("title_short"), none.alias("title"), none.alias("author"), none.alias("lccn"), "marc")
    return R.marc_fields(m.withColumn("title", marc._raw(F.col("marc"), "245", "a")).withColumn("author", R.first_value(F.col("marc"), "100", "a")))


def marc_fields(spark: SparkSession, d: str) -> DataFrame:
    return R.resolvable(_fields(spark, d)).select("id", "author", "title", "uniform_title", "lccn", "hub_uri")


def marc_758(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("id", F.inline("work_relations"))


def self_hub_pick(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("id", R.self_hub(F.col("work_relations")).alias("self_hub"))


# RDF: relations written as RDF/XML and read back


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    g = fixture.graph(spark, d)
    r = g.relation.join(g.relation_type, "relation_id", "left")
    about = F.coalesce(F.concat(F.lit(' rdf:about="'), "type_uri", F.lit('"')), F.lit(""))
    one = F.concat(F.lit("<bf:relation><bf:Relation><bf:relationship><bf:Relationship"), about, F.lit('/></bf:relationship><bf:associatedResource><bf:Hub rdf:about="'), "target_uri", F.lit('"/></bf:associatedResource></bf:Relation></bf:relation>'))
    e = r.groupBy("source_uri").agg(F.array_sort(F.collect_list(F.struct("relation_id", F.coalesce("type_uri", F.lit("")).alias("t"), one.alias("x")))).alias("l"))
    head = F.concat(F.lit(f'<rdf:RDF xmlns:rdf="{rdfxml.RDF}" xmlns:bf="{_C.ontology}"><bf:Work rdf:about="'), "source_uri", F.lit('">'))
    body = F.concat(head, F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</bf:Work></rdf:RDF>"))
    return e.select(F.col("source_uri").alias("hub_uri"), F.lit(200).alias("http_status"), F.lit("application/rdf+xml").alias("content_type"), body.alias("body"))


def rdf_relations(spark: SparkSession, d: str) -> DataFrame:
    return rdfxml.relations(rdfxml.parse(rdfxml.usable(_payloads(spark, d)), dedup=False)).select("source_uri", "target_uri", "rel_type", "is_direct")


def rdf_dedup(spark: SparkSession, d: str) -> DataFrame:
    return rdfxml.dedup_relations(rdfxml.relations(rdfxml.parse(_payloads(spark, d), dedup=False))).select("source_uri", "target_uri", "rel_type")


def rdf_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The same by the parser's own rule, relation by relation."""
    return rdfxml.relations(rdfxml.parse(_payloads(spark, d))).select("source_uri", "target_uri", "rel_type")


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """A payload per part with titles, agents, media, labelled and direct relations; some are pages, missing, empty or broken."""
    key, size = F.col("p_partkey"), F.col("p_size")
    hub = lambda n: fixture.hub_uri(key + n, _C)
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    title = lambda c: text("<bf:title><bf:Title><bf:mainTitle> ", c, "</bf:mainTitle></bf:Title></bf:title>")
    agent = lambda c: text('<bf:contribution><bf:Contribution><bf:agent><bf:Agent rdf:about="', c, '"/></bf:agent></bf:Contribution></bf:contribution>')
    kind = (
        F.when(size % 5 == 0, text(f'<bf:Relationship rdf:about="{_ENT}Sequel"><rdfs:label>Based on (work)</rdfs:label></bf:Relationship>')).when(size % 5 == 1, text("<bf:Relationship><rdfs:label>Based on (work)</rdfs:label></bf:Relationship>"))
        .when(size % 5 == 2, text("<bf:Relationship><rdfs:label>Retold in (expression)</rdfs:label></bf:Relationship>")).when(size % 5 == 3, text(f'<bf:Relationship rdf:about="{_VOC}partof"><rdfs:label>related work</rdfs:label></bf:Relationship>'))
        .otherwise(F.lit(""))
    )
    held = F.when(size % 2 == 0, title(F.col("p_brand"))).otherwise(F.lit(""))
    relation = text('<bf:relation><bf:Relation><bf:relationship>', kind, '</bf:relationship><bf:associatedResource><bf:Hub rdf:about="', hub(1), '">', held, "</bf:Hub></bf:associatedResource></bf:Relation></bf:relation>")
    direct = F.when(size % 3 == 0, text(f'<bf:translationOf rdf:resource="http://{_C.host}/resources/works/', key.cast("string"), '"/>')).when(size % 3 == 1, text('<bf:relatedTo><bf:Hub rdf:about="', hub(2), '"/></bf:relatedTo>')).otherwise(F.lit(""))
    inner = text(
        title(F.col("p_name")), f'<rdf:type rdf:resource="{_C.ontology}', F.col("p_type"), f'"/><rdf:type rdf:resource="{_C.ontology}', F.col("p_type"), '"/>', F.when(size % 7 != 0, text(agent(F.col("p_brand")), agent(F.col("p_brand")))).otherwise(F.lit("")),
        F.when(size % 11 != 0, text(relation, direct)).otherwise(F.lit("")),
    )
    body = text(f'<rdf:RDF xmlns:rdf="{rdfxml.RDF}" xmlns:rdfs="{rdfxml.RDFS}" xmlns:bf="{_C.ontology}"><bf:Work rdf:about="', hub(0), '">', inner, "</bf:Work></rdf:RDF>")
    body = F.when(size % 13 == 3, "").when(size % 13 == 4, F.concat(F.lit(" <!DOCTYPE html>"), body)).when(size % 13 == 5, F.substring(body, 1, 200)).otherwise(body)
    return read(spark, d, "part").select(
        hub(0).alias("hub_uri"), F.when(size % 13 == 1, 404).otherwise(200).alias("http_status"), F.when(size % 13 == 2, "Text/HTML; charset=utf-8").when(size % 13 != 6, "application/rdf+xml").alias("content_type"), body.alias("body")
    )


def rdf_stated(spark: SparkSession, d: str) -> DataFrame:
    """Relations by label, by address and direct ones, with their titles, of payloads of every kind."""
    return rdfxml.relations(rdfxml.parse(rdfxml.usable(_stated(spark, d)))).select("source_uri", "target_uri", "rel_type", "title", "is_direct")


def rdf_hubs(spark: SparkSession, d: str) -> DataFrame:
    """What the same payloads say of their hubs."""
    p = rdfxml.parse(rdfxml.usable(_stated(spark, d)))
    return p.select("uri", "title", F.array_join("agents", "|").alias("agents"), F.array_join("media", "|").alias("media"), F.size("relations").alias("n_relations"))


def new_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hubs whose RDF was read and holds no relation; failed reads are not among them."""
    return P.new_negatives(_stated(spark, d), F.lit("2024-01-01").cast("timestamp")).select("uri")


def related_titles(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline over records with an own, a suggested and a base hub and known empty RDF: which source won, the primary hub
    if it is valid, its title, and the titles of the results."""
    p = read(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    hub = lambda n: fixture.hub_uri(key + n, _C)
    records = p.select(key.alias("id"), F.when(size % 2 == 0, hub(0)).alias("hub_uri"), F.when(size % 4 < 2, hub(1)).alias("suggested_uri"), F.when(size % 3 == 0, hub(2)).alias("base_uri"), F.when(size % 5 != 0, F.col("p_brand")).alias("title"))
    negative = p.filter("p_size % 4 = 0").select(hub(0).alias("uri"), F.lit("2024-01-01").cast("timestamp").alias("checked_at"))
    log = p.select(F.explode(F.array(hub(0), hub(1))).alias("uri"), F.lit(True).alias("valid"), F.lit("2024-01-01").cast("timestamp").alias("checked_at"), (key % 3 != 0).alias("ok")).filter("ok").drop("ok")
    r = P.related_works(records, fixture.graph(spark, d, keep=True), _stated(spark, d), negative, log, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    return r.select("id", "source", "primary_uri", "hub_title", "target_uri", "title", "rel_type", "shown_rank")


def label_details(spark: SparkSession, d: str) -> DataFrame:
    """The label endpoint: the hub of each exact label, with the label of the first hit of a search for it."""
    # Only the smallest hub of a label can be found by it, and be its first hit; written once, as all three tables come from it.
    lab = checkpoint(_labels(spark, d).groupBy("label").agg(F.min("hub_uri").alias("hub_uri")))
    hits = lab.select(F.col("hub_uri").alias("uri"), F.col("label").alias("aLabel"))
    wanted = lab.select(F.col("label").alias("id"), "label")
    return R.label_hits(wanted, lab, lambda q: R.suggest_search(q, hits, 1, left_anchored=True)).select(F.col("id").alias("label"), "uri", "aLabel", "token")


def legacy_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ten best connected hubs with a word in their titles."""
    return L.candidates(fixture.graph(spark, d).title, _legacy(spark, d)[0], "RED")


def marc_fullrecord(spark: SparkSession, d: str) -> DataFrame:
    """Index documents hold the stored record: what is read from it again."""
    rows = read(spark, d, "part").select(_marc_xml().alias("xml")).select("xml", marc.from_column(F.col("xml")).alias("marc"))
    again = marc.from_column(F.col("fullrecord"))
    return marc.index_document(rows, "show").select("id", R.first_value(again, "245", "a").alias("title_proper"), marc.control(again, "001").alias("number"))


def fallback_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first source of relations that has any: specific ones before all."""
    rel = G.typed_relations(fixture.graph(spark, d))
    some = rel.filter(X.tier(F.col("rel_type")) <= 2).withColumn("priority", F.lit(1))
    c = some.unionByName(rel.withColumn("priority", F.lit(2))).select(F.col("source_uri").alias("id"), "priority", "target_uri", "rel_type")
    return P.first_candidate(c)


def related_works(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over every part as a record: RDF first, then the graph, validated and capped."""
    p = read(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    records = p.select(key.alias("id"), F.when(size % 2 == 0, fixture.hub_uri(key, _C)).alias("hub_uri"), fixture.hub_uri(key, _C).alias("suggested_uri"), F.lit(None).cast("string").alias("base_uri"))
    log, as_of = _log(spark, d)
    r = P.related_works(records, fixture.graph(spark, d), _payloads(spark, d), None, log, as_of)
    return r.select("id", "source", "source_uri", "target_uri", "rel_type", F.round("score", 6).alias("score"), "rank", "shown_rank")


# The older model


def _legacy(spark: SparkSession, d: str, g: Graph | None = None) -> tuple[DataFrame, DataFrame]:
    e = fixture.edges(spark, d)
    kinds = F.element_at(F.array(*map(F.lit, L.DIRECT_TIERS)), F.col("l_linenumber") % 3 + 1)
    a, b = fixture.hub_uri(F.col("l_partkey"), _C).alias("source_uri"), fixture.hub_uri(F.col("b_part"), _C).alias("target_uri")
    edges = e.select(a, kinds.alias("edge_type"), b).distinct()
    g = g or fixture.graph(spark, d)
    typed = g.relation.join(g.relation_type, "relation_id").join(g.hub, F.col("target_uri") == F.col("hub_uri"), "left_semi").select("source_uri", "type_uri", "target_uri").distinct()
    return edges, typed


def legacy_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return L.one_per_target(L.neighbours(*_legacy(spark, d)))


def legacy_score(spark: SparkSession, d: str) -> DataFrame:
    g = fixture.graph(spark, d, keep=True)
    s = L.score(L.one_per_target(L.neighbours(*_legacy(spark, d, g))), G.hub_context(g), G.type_frequencies(g), 21_000)
    return s.select("source_uri", "target_uri", "tier", F.round("score", 6).alias("score"))


def legacy_degree(spark: SparkSession, d: str) -> DataFrame:
    return L.degree(_legacy(spark, d)[0])


QUERIES = {
    f.__name__: f
    for f in (
        validation_latest, needs_check_anti, validated_semi, validate_window_cap, negative_cache_skip, validation_urls, strip_article, trim_punct, access_point, base_label, percent_encode, title_bm25, hub_by_title,
        lccn_lookup, resolve_cascade, label_strategy, base_work, verify_lccn, marc_index_doc, marc_totals, marc_not_loaded, marc_fields, marc_758, self_hub_pick, rdf_relations, rdf_dedup, rdf_parsed, fallback_priority,
        related_works, legacy_neighbours, legacy_score, legacy_degree, rdf_stated, rdf_hubs, new_negatives, related_titles, label_details, legacy_candidates, marc_fullrecord,
    )
}

_LOG = f"""log AS (SELECT '{_H}' || user_id AS uri, event_type <> 'error' AS valid, ts AS checked_at FROM events), t0 AS (SELECT max(ts) AS t0 FROM events),
last AS (SELECT uri, valid, checked_at FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY checked_at DESC, valid DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT last.* FROM last, t0 WHERE epoch_us(t0) - epoch_us(checked_at) < {_DAY}000000)"""
_TITLES = """titles AS (SELECT p_partkey, p_name, p_size, CASE p_size % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'A ' ELSE '' END || p_name
  || CASE p_size % 4 WHEN 0 THEN ' /' WHEN 1 THEN '.' WHEN 2 THEN ' :' ELSE '' END AS title FROM part)"""
_ART = "regexp_replace(trim({t}), '(?i)^(the|a|an)\\s+', '')"
_LABELS = f"""lab AS (SELECT '{_H}' || p_partkey AS hub_uri, s_name AS author, upper(p_name[1]) || p_name[2:] AS title, p_size,
  s_name || '. ' || upper(p_name[1]) || p_name[2:] || (['', '. Russian', '. Selections', ' (Motion picture)', '. Act 2'])[p_size % 5 + 1] AS label
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _base(s: str) -> str:
    rules = ("(?i)\\.\\s+(Selections|Libretto|Vocal score|Piano score)(\\.|$)", "(?i)\\.\\s+(Act\\s+\\d+.*?)$", "\\.\\s+[A-Z][a-z]+(\\s+&\\s+[A-Z][a-z]+)?$", "\\s+\\([^)]+\\)$")
    new = [f"regexp_replace({s}, '{r}', '', 'g')" for r in rules]
    return "CASE " + " ".join(f"WHEN {n} <> {s} AND {n} <> '' THEN {n}" for n in new) + f" ELSE {s} END"


_TOK = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}#]+'), lambda x: x <> '')"
_BM = f"""{Q.GRAPH}, {_TITLES},
q AS (SELECT DISTINCT {_ART.format(t="rtrim(title, ' /;:,.')")} AS id FROM titles), qt AS (SELECT DISTINCT id, unnest({_TOK.format(t='id')}) AS token FROM q), qn AS (SELECT id, count(*) AS n_terms FROM qt GROUP BY 1),
tt AS (SELECT hub_uri, title_node, unnest({_TOK.format(t="array_to_string(main_titles, ' ')")}) AS token FROM g_title),
tf AS (SELECT hub_uri, title_node, token, count(*) AS tf FROM tt GROUP BY ALL), ln AS (SELECT title_node, sum(tf) AS length FROM tf GROUP BY 1), dfs AS (SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*)::DOUBLE FROM g_title) AS n, (SELECT avg(length) FROM (SELECT length FROM ln UNION ALL SELECT 0 FROM g_title WHERE title_node NOT IN (SELECT title_node FROM ln))) AS mean),
hit AS (SELECT qt.id, n_terms, tf.title_node, hub_uri, sum(ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS relevance, count(*) AS n_hit
  FROM qt JOIN qn ON qt.id = qn.id JOIN tf ON qt.token = tf.token JOIN dfs ON qt.token = dfs.token JOIN ln ON tf.title_node = ln.title_node, st GROUP BY ALL),
good AS (SELECT id, title_node, hub_uri, relevance FROM hit WHERE n_hit = n_terms)"""
_BEST = """few AS (SELECT * FROM (SELECT id, hub_uri, row_number() OVER (PARTITION BY id ORDER BY round(max(relevance), 9) DESC, hub_uri) AS rn FROM {good} GROUP BY id, hub_uri) WHERE rn <= 30),
best AS (SELECT id, hub_uri, rels FROM (SELECT few.id, few.hub_uri, out_rels + in_rels AS rels, row_number() OVER (PARTITION BY few.id ORDER BY out_rels + in_rels DESC, few.hub_uri) AS rn
  FROM few JOIN deg ON few.hub_uri = deg.hub_uri) WHERE rn = 1)"""
_ORIGINAL = "rtrim(p_name || ' :', ' /;:,.')"
_PL = f"""pl AS (SELECT r.source_uri, r.target_uri, r.relation_id, coalesce(t.type_uri, '') AS type_uri,
  CASE WHEN starts_with(t.type_uri, '{_ENT}') THEN replace(t.type_uri, '{_ENT}', '') WHEN t.type_uri IN ('{_VOC}relatedwork', '{_VOC}translatedas', '{_VOC}partof', '{_VOC}expressionof') THEN replace(t.type_uri, '{_VOC}', '')
  ELSE 'relatedwork' END AS rel_type FROM g_relation r LEFT JOIN g_relation_type t ON r.relation_id = t.relation_id WHERE r.target_uri LIKE '%/resources/hubs/%')"""
_RDF = f"{Q.GRAPH}, {_PL}"
_RDF_ONE = f"WITH {_RDF} SELECT source_uri, target_uri, rel_type FROM (SELECT *, row_number() OVER (PARTITION BY source_uri, target_uri ORDER BY rel_type = 'relatedwork', relation_id, type_uri) AS rn FROM pl) WHERE rn = 1"
_LEGACY = f"""{Q.GRAPH}, de AS (SELECT DISTINCT '{_H}' || l_partkey AS source_uri, (['ns0__translationOf', 'ns0__relatedTo', 'ns0__arrangementOf'])[l_linenumber % 3 + 1] AS edge_type, '{_H}' || b_part AS target_uri FROM e),
ty AS (SELECT DISTINCT source_uri, replace(type_uri, '{_ENT}', '') AS t, target_uri FROM g_relation JOIN g_relation_type USING (relation_id) WHERE target_uri IN (SELECT hub_uri FROM g_hub) AND NOT starts_with(type_uri, 'bnode')),
ln AS (SELECT source_uri, target_uri, edge_type AS rel_type, true AS is_direct, 0 AS seq FROM de
  UNION ALL SELECT target_uri, source_uri, edge_type || '_INBOUND', true, 1 FROM de WHERE edge_type <> 'ns0__relatedTo'
  UNION ALL SELECT source_uri, target_uri, t, false, 2 FROM ty UNION ALL SELECT target_uri, source_uri, t || '_INBOUND', false, 3 FROM ty),
lone AS (SELECT source_uri, target_uri, rel_type, is_direct FROM (SELECT *, row_number() OVER (PARTITION BY source_uri, target_uri ORDER BY is_direct, seq, rel_type) AS rn FROM ln) WHERE rn = 1)"""
_LTIER = "CASE WHEN is_direct AND replace(rel_type, '_INBOUND', '') = 'ns0__translationOf' THEN 5 WHEN is_direct AND replace(rel_type, '_INBOUND', '') = 'ns0__relatedTo' THEN 3 WHEN is_direct AND replace(rel_type, '_INBOUND', '') = 'ns0__arrangementOf' THEN 4 ELSE " + Q.tier("slug") + " END"
_STATED = f"""st AS (SELECT '{_H}' || p_partkey AS uri, p_partkey AS k, p_size AS z, p_name, p_brand, p_type FROM part WHERE p_size % 13 NOT IN (1, 2, 3, 4, 5)),
st_rel AS (SELECT uri AS source_uri, '{_H}' || (k + 1) AS target_uri, CASE z % 5 WHEN 0 THEN 'sequel' WHEN 1 THEN 'basedon' WHEN 2 THEN 'retoldin' WHEN 3 THEN 'partof' ELSE 'relatedwork' END AS rel_type, CASE WHEN z % 2 = 0 THEN p_brand END AS title, false AS is_direct FROM st WHERE z % 11 <> 0
  UNION ALL SELECT uri, 'http://{_C.host}/resources/works/' || k, 'translationof', NULL, true FROM st WHERE z % 11 <> 0 AND z % 3 = 0
  UNION ALL SELECT uri, '{_H}' || (k + 2), 'relatedto', NULL, true FROM st WHERE z % 11 <> 0 AND z % 3 = 1),
st_hub AS (SELECT uri, p_name AS title, CASE WHEN z % 7 <> 0 THEN p_brand ELSE '' END AS agents, '{_C.ontology}' || p_type AS media FROM st)"""
# Every supplier's name has one length, so of all labels that begin with a label the shortest is that label itself.
SQL = {
    "rdf_stated": f"WITH {_STATED} SELECT * FROM st_rel",
    "rdf_hubs": f"WITH {_STATED} SELECT uri, title, agents, media, (SELECT count(*) FROM st_rel WHERE source_uri = uri)::INT AS n_relations FROM st_hub",
    "new_negatives": f"WITH {_STATED} SELECT uri FROM st WHERE z % 11 = 0",
    "label_details": f"WITH {_LABELS}, one AS (SELECT label, min(hub_uri) AS uri FROM lab GROUP BY 1) SELECT label, uri, label AS \"aLabel\", regexp_extract(uri, '[^/]+$') AS token FROM one",
    "legacy_candidates": f"WITH {_LEGACY} SELECT source_uri AS hub_uri, count(*) AS rel_count FROM de WHERE source_uri IN (SELECT hub_uri FROM g_title WHERE len(list_filter(main_titles, lambda t: contains(lower(t), 'red'))) > 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "marc_fullrecord": "SELECT 'show-' || p_partkey AS id, p_name || ' :' AS title_proper, p_partkey::VARCHAR AS number FROM part WHERE p_size % 9 <> 0",
    "related_titles": f"""WITH {Q.SCORED}, {_STATED},
        f AS (SELECT r.*, {Q.clean('rel_type')} AS slug FROM st_rel r WHERE source_uri NOT IN (SELECT '{_H}' || p_partkey FROM part WHERE p_size % 4 = 0)),
        fk AS (SELECT f.*, coalesce(q.freq, 0) AS freq, mx.max_freq, {Q.tier('f.slug')} AS tier, s.agents AS sg, s.media AS smd, c.agents AS tg, {Q.specific('c.media')} AS tmd, coalesce(f.title, c.title) AS shown_title
          FROM f CROSS JOIN mx LEFT JOIN freq q ON f.slug = q.rel_type LEFT JOIN ctx c ON f.target_uri = c.hub_uri LEFT JOIN st_hub s ON f.source_uri = s.uri),
        fs AS (SELECT *, least(100.0::DOUBLE, {Q._BASE.format(t='tier')} + {Q.rarity('freq', 'max_freq')} + CASE WHEN sg = '' OR len(coalesce(tg, [])) = 0 THEN 5.0 ELSE 15.0 END + CASE WHEN len(coalesce(tmd, [])) > 0 THEN 10.0 ELSE 3.0 END) AS score FROM fk),
        fr AS (SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY score DESC, target_uri) AS rank FROM fs),
        rec AS (SELECT p_partkey AS id, p_size AS z, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS own, CASE WHEN p_size % 2 = 0 THEN '{_H}' || p_partkey END AS u0, CASE WHEN p_size % 4 < 2 THEN '{_H}' || (p_partkey + 1) END AS u1,
          CASE WHEN p_size % 3 = 0 THEN '{_H}' || (p_partkey + 2) END AS u2 FROM part),
        w AS (SELECT id, own, 0 AS prio, u0 AS src, 'rdf' AS source FROM rec UNION ALL SELECT id, own, 1, u1, 'rdf' FROM rec UNION ALL SELECT id, own, 2, u2, 'rdf' FROM rec
          UNION ALL SELECT id, own, 3, u1, 'graph' FROM rec UNION ALL SELECT id, own, 4, u0, 'graph' FROM rec),
        res AS (SELECT 'rdf' AS source, source_uri, target_uri, rel_type, shown_title AS title, score, rank FROM fr UNION ALL SELECT 'graph', source_uri, target_uri, rel_type, title, score, rank FROM ranked),
        hit AS (SELECT w.id, w.own, w.prio, res.* FROM w JOIN res ON w.src = res.source_uri AND w.source = res.source), top AS (SELECT id, min(prio) AS prio FROM hit GROUP BY 1),
        ok AS (SELECT '{_H}' || p_partkey AS uri FROM part WHERE p_partkey % 3 <> 0 UNION SELECT '{_H}' || (p_partkey + 1) FROM part WHERE p_partkey % 3 <> 0),
        one2 AS (SELECT hit.*, row_number() OVER (PARTITION BY hit.id ORDER BY rank) AS shown_rank FROM hit JOIN top ON hit.id = top.id AND hit.prio = top.prio WHERE rank <= 45 AND target_uri IN (SELECT uri FROM ok))
        SELECT id, source, CASE WHEN source_uri IN (SELECT uri FROM ok) THEN source_uri END AS primary_uri, coalesce(CASE WHEN source = 'rdf' THEN (SELECT title FROM st_hub WHERE uri = source_uri) END, own, (SELECT title FROM ctx WHERE hub_uri = source_uri)) AS hub_title,
          target_uri, title, rel_type, shown_rank FROM one2 WHERE shown_rank <= 15""",
    "validation_latest": f"WITH {_LOG} SELECT uri, valid, epoch_us(checked_at) AS checked_us, epoch_us(t0) - epoch_us(checked_at) < {_DAY}000000 AS fresh FROM last, t0",
    "needs_check_anti": f"WITH {_LOG}, {Q.GRAPH} SELECT DISTINCT target_uri AS uri FROM g_relation WHERE target_uri NOT IN (SELECT uri FROM live)",
    "validated_semi": f"WITH {_LOG} SELECT uri FROM live WHERE valid",
    "validate_window_cap": f"""WITH {_LOG}, {Q.SCORED}, w AS (SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY rank) AS shown_rank FROM ranked WHERE rank <= 45 AND target_uri IN (SELECT uri FROM live WHERE valid))
        SELECT source_uri, target_uri, rank, shown_rank FROM w WHERE shown_rank <= 15""",
    "negative_cache_skip": f"""WITH {_LOG}, {Q.GRAPH} SELECT hub_uri FROM g_hub WHERE hub_uri NOT IN
        (SELECT '{_H}' || user_id FROM events, t0 WHERE event_type = 'signup' GROUP BY 1, t0 HAVING epoch_us(t0) - epoch_us(max(ts)) < {_DAY}000000)""",
    "validation_urls": f"""WITH {Q.GRAPH} SELECT DISTINCT target_uri AS uri, target_uri || '.rdf' AS checked, replace(target_uri, 'http://', 'https://') || '.rdf' AS rdf, regexp_extract(target_uri, '[^/]+$') AS name,
        regexp_extract(target_uri, '://[^/]+(/.*)$', 1) AS path, target_uri LIKE '%/resources/hubs/%' AS is_hub FROM g_relation""",
    "strip_article": f"WITH {_TITLES} SELECT p_partkey, {_ART.format(t='title')} AS title, len(regexp_split_to_array({_ART.format(t='title')}, '\\s+'))::INT AS n_words FROM titles",
    "trim_punct": f"WITH {_TITLES} SELECT p_partkey, rtrim(title, ' /;:,.') AS title FROM titles",
    "access_point": f"WITH {_LABELS} SELECT hub_uri, author || '. ' || title AS access_point FROM lab",
    "base_label": f"WITH {_LABELS} SELECT DISTINCT label, {_base('label')} AS base FROM lab",
    "percent_encode": f"WITH {_LABELS} SELECT DISTINCT label, url_encode(label) AS path, replace(url_encode(label), '%20', '+') AS query FROM lab",
    "title_bm25": f"WITH {_BM} SELECT id, hub_uri, round(relevance, 6) AS relevance FROM good",
    "hub_by_title": f"WITH {_BM}, {_BEST.format(good='good')} SELECT id, hub_uri, rels FROM best",
    "lccn_lookup": f"SELECT p_partkey AS id, '{_H}' || p_partkey AS hub_uri FROM part",
    "resolve_cascade": f"""WITH {_BM}, {_BEST.format(good='good')} SELECT p_partkey AS id, CASE p_size % 4 WHEN 2 THEN hub_uri WHEN 3 THEN NULL ELSE '{_H}' || p_partkey END AS hub_uri,
        CASE p_size % 4 WHEN 0 THEN 'marc' WHEN 1 THEN 'lccn' WHEN 2 THEN 'title' ELSE 'none' END AS strategy FROM part LEFT JOIN best ON best.id = p_name""",
    "verify_lccn": "SELECT p_partkey AS id, p_size % 2 = 0 AS verified FROM part",
    "label_strategy": f"""WITH {_LABELS}, r AS (SELECT DISTINCT hub_uri, author, CASE WHEN p_size % 5 = 0 THEN 'label_author_uniform' WHEN p_size % 5 = 1 THEN 'label_uniform' WHEN p_size % 2 = 0 THEN 'suggest_author_title' ELSE 'none' END AS strategy FROM lab)
        SELECT strategy, count(*) AS n_records, count(*) FILTER (strategy <> 'none') AS n_found FROM r GROUP BY 1""",
    "related_works": f"""WITH {_LOG}, {Q.SCORED}, {_PL},
        ro AS (SELECT *, {Q.clean('rel_type')} AS slug FROM (SELECT *, row_number() OVER (PARTITION BY source_uri, target_uri ORDER BY rel_type = 'relatedwork', relation_id, type_uri) AS rn FROM pl) WHERE rn = 1),
        rk AS (SELECT ro.*, coalesce(f.freq, 0) AS freq, mx.max_freq, {Q.tier('slug')} AS tier, len({Q.specific('c.media')}) AS nm FROM ro CROSS JOIN mx LEFT JOIN freq f ON slug = f.rel_type LEFT JOIN ctx c ON target_uri = c.hub_uri),
        rs AS (SELECT *, least(100.0::DOUBLE, {Q._BASE.format(t='tier')} + {Q.rarity('freq', 'max_freq')} + 5.0 + CASE WHEN nm > 0 THEN 8.0 ELSE 0.0 END) AS score FROM rk),
        rr AS (SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY score DESC, target_uri) AS rank FROM rs),
        every AS (SELECT 'rdf' AS source, source_uri, target_uri, rel_type, score, rank FROM rr
          UNION ALL SELECT 'graph', source_uri, target_uri, rel_type, score, rank FROM ranked WHERE source_uri NOT IN (SELECT source_uri FROM rr)),
        w AS (SELECT every.*, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey ORDER BY rank) AS shown_rank FROM every JOIN part ON source_uri = '{_H}' || p_partkey
          WHERE rank <= 45 AND target_uri IN (SELECT uri FROM live WHERE valid))
        SELECT id, source, source_uri, target_uri, rel_type, round(score, 6) AS score, rank, shown_rank FROM w WHERE shown_rank <= 15""",
    "base_work": f"WITH {_LABELS}, b AS (SELECT DISTINCT label, {_base('label')} AS base FROM lab), l AS (SELECT label, min(hub_uri) AS hub_uri FROM lab GROUP BY 1) SELECT b.label AS id, l.hub_uri FROM b JOIN l ON b.base = l.label WHERE b.base <> b.label",
    "marc_index_doc": """SELECT 'show-' || p_partkey AS id, t AS title, lower(t) AS title_sort, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_brand END AS author, CASE WHEN p_size % 2 = 0 THEN 'eng' ELSE 'fre' END AS lang,
        CASE WHEN p_size % 7 <> 0 THEN (1900 + p_size)::VARCHAR ELSE '1850' END AS date, 'marc' AS record_format FROM (SELECT *, p_name || CASE WHEN p_size % 2 = 0 THEN ': ' || p_type ELSE '' END AS t FROM part) WHERE p_size % 9 <> 0""",
    "marc_totals": "SELECT count(*) FILTER (p_size % 9 <> 0) AS n_loaded, count(*) FILTER (p_size % 9 = 0) AS n_skipped FROM part",
    "marc_not_loaded": "SELECT 'show-' || p_partkey AS id FROM part WHERE p_size % 9 <> 0 AND p_size >= 25",
    "marc_fields": f"""SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS author, p_name AS title, CASE WHEN p_size % 6 = 0 THEN p_name END AS uniform_title,
        CASE WHEN p_size % 4 = 0 THEN lpad(p_partkey::VARCHAR, 10, '0') END AS lccn, CASE WHEN p_size % 6 = 0 OR (p_size % 3 < 2 AND p_size % 8 <> 0) THEN '{_H}' || p_partkey END AS hub_uri FROM part""",
    "marc_758": f"""SELECT p_partkey AS id, CASE WHEN p_size % 8 <> 0 THEN '{_H}' || p_partkey END AS "hubUri", NULL::VARCHAR AS "authUri", p_name AS label,
        CASE p_size % 3 WHEN 0 THEN 'Has work manifested' WHEN 1 THEN 'Expression of' ELSE 'Sequel' END AS "relLabel", '{_VOC}sequel' AS "relUri", p_size % 3 < 2 AS "isSelfHub" FROM part""",
    "self_hub_pick": f"SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 AND p_size % 8 <> 0 THEN '{_H}' || p_partkey END AS self_hub FROM part",
    "rdf_relations": f"WITH {_RDF} SELECT source_uri, target_uri, rel_type, false AS is_direct FROM pl",
    "rdf_dedup": _RDF_ONE,
    "rdf_parsed": _RDF_ONE,
    "fallback_priority": f"""WITH {Q.GRAPH}, c AS (SELECT source_uri AS id, 1 AS priority, target_uri, rel_type FROM typed WHERE {Q.tier('rel_type')} <= 2 UNION ALL SELECT source_uri, 2, target_uri, rel_type FROM typed)
        SELECT * FROM c WHERE priority = (SELECT min(priority) FROM c AS x WHERE x.id = c.id)""",
    "legacy_neighbours": f"WITH {_LEGACY} SELECT * FROM lone",
    "legacy_score": f"""WITH {_LEGACY}, j AS (SELECT lone.*, {Q.clean('lone.rel_type')} AS slug, coalesce(f.freq, 0) AS freq, s.agents AS sa, t.agents AS ta, {Q.specific('s.media')} AS sm, {Q.specific('t.media')} AS tm
          FROM lone LEFT JOIN freq f ON {Q.clean('lone.rel_type')} = f.rel_type LEFT JOIN ctx s ON source_uri = s.hub_uri LEFT JOIN ctx t ON target_uri = t.hub_uri),
        k AS (SELECT *, {_LTIER} AS tier FROM j)
        SELECT source_uri, target_uri, tier, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, {Q._BASE.format(t='tier')} + {Q.rarity('freq', '21000')} + {Q.author('sa', 'ta')}
          + CASE WHEN len(sm) > 0 AND len(tm) > 0 AND list_sort(sm) <> list_sort(tm) THEN 10.0 WHEN len(sm) = 0 AND len(tm) > 0 THEN 8.0 WHEN len(sm) > 0 AND len(tm) = 0 THEN 3.0 ELSE 0.0 END)), 6) AS score FROM k""",
    "legacy_degree": f"WITH {_LEGACY} SELECT source_uri AS hub_uri, count(*) AS rel_count FROM de GROUP BY 1",
}
