"""Graph, resolution, validation, sinks and streams on small hand-made inputs."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.operators import graph as G
from kinweave.operators import legacy as L
from kinweave.operators import resolve as R
from kinweave.operators import scoring as S
from kinweave.operators import validation as V
from kinweave.plans import related as P
from kinweave.sources import sinks
from kinweave.streaming import cache_log

C = Config()
NOW = datetime(2024, 5, 1)


def test_one_per_target_does_not_depend_on_order(spark):
    rows = [("a", "b", "related", False, False), ("a", "b", "sequel_INBOUND", False, True), ("a", "b", "relatedto", False, False), ("a", "c", "relatedwork", False, False), ("a", "c", "related_INBOUND", False, True)]
    schema = "source_uri string, target_uri string, rel_type string, is_direct boolean, is_inbound boolean"
    for order in (rows, rows[::-1]):
        got = {(r["target_uri"], r["rel_type"]) for r in G.one_per_target(spark.createDataFrame(order, schema)).collect()}
        assert got == {("b", "sequel_INBOUND"), ("c", "relatedwork")}


def context(spark, rows):
    return spark.createDataFrame(rows, "hub_uri string, title string, agents array<string>, media array<string>")


def related(spark, *rows):
    return spark.createDataFrame(list(rows), "source_uri string, target_uri string, rel_type string")


def freq(spark, *rows):
    return spark.createDataFrame(list(rows), "rel_type string, freq long")


def test_scores_of_the_documentation(spark):
    ctx = context(spark, [("s", "S", ["x"], [C.generic_media[0]]), ("t", "T", ["y"], [C.generic_media[0]]), ("u", None, ["x"], None)])
    scored = S.score(related(spark, ("s", "t", "parodyof"), ("s", "u", "translationof"), ("s", "gone", "sequel")), ctx, freq(spark, ("translationof", 21_000), ("sequel", 500)))
    got = {r["target_uri"]: r for r in scored.collect()}
    assert got["t"]["score"] == 100.0 and got["t"]["different_author"]
    assert got["u"]["score"] == pytest.approx(10.0) and got["u"]["title"] is None
    assert got["gone"]["author_bonus"] == 5.0 and 55 < got["gone"]["score"] < 70


def test_without_frequencies_every_type_is_unknown(spark):
    r = S.score(related(spark, ("s", "t", "sequel")), context(spark, []), freq(spark)).first()
    assert r["rarity_bonus"] == 5.0


def test_groups_take_the_tier_of_their_best_row(spark):
    ctx = context(spark, [("t1", "T", ["y"], []), ("t2", "T", ["x"], []), ("s", "S", ["x"], [])])
    g = S.grouped(S.ranked(S.score(related(spark, ("s", "t1", "sequel"), ("s", "t2", "sequelto")), ctx, freq(spark)))).collect()
    assert len(g) == 1 and g[0]["n_results"] == 2 and [x["target_uri"] for x in g[0]["results"]] == ["t1", "t2"] and not g[0]["expanded"]


def test_validation(spark):
    log = spark.createDataFrame([("a", False, NOW - timedelta(hours=2)), ("a", True, NOW - timedelta(hours=1)), ("b", True, NOW - timedelta(days=1)), ("c", False, NOW), (None, True, NOW)], "uri string, valid boolean, checked_at timestamp")
    as_of = F.lit(NOW)
    assert {r["uri"] for r in V.valid_uris(log, as_of, 86_400).collect()} == {"a"}
    uris = spark.createDataFrame([("a",), ("b",), ("b",), ("d",), ("",), (None,)], "uri string")
    assert {r["uri"] for r in V.need_check(uris, log, as_of, 86_400).collect()} == {"b", "d"}
    ranked = spark.createDataFrame([("s", f"t{k}", k) for k in range(1, 60)], "source_uri string, target_uri string, rank int")
    ok = spark.createDataFrame([(f"t{k}",) for k in (2, 9, 30, 31, 50)], "uri string")
    assert [r["target_uri"] for r in V.shown(ranked, ok, Config(max_display=3)).orderBy("rank").collect()] == ["t2", "t9"]
    assert V.shown(ranked, ok, Config(validate_uris=False)).count() == 59
    assert {r["uri"]: r["valid"] for r in V.check_live(uris, lambda u: u == "a", 2).collect()} == {"a": True, "b": False, "d": False}
    rec = spark.createDataFrame([("1", "t2"), ("2", "no")], "id string, hub_uri string")
    assert {r["id"]: r["hub_uri"] for r in V.valid_primary(rec, ok).collect()} == {"1": "t2", "2": None}


def test_candidates(spark):
    c = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 4, "w")], "id string, priority int, t string")
    assert {(r["id"], r["t"]) for r in P.first_candidate(c).collect()} == {("a", "y"), ("a", "z"), ("b", "w")}


def test_label_lookups(spark):
    labels = spark.createDataFrame([("A. Hamlet", "h2"), ("A. Hamlet", "h1"), ("Faust", "h3")], "label string, hub_uri string")
    records = spark.createDataFrame([("1", "A", "Hamlet", None), ("2", None, "Faust", "x"), ("3", None, None, "Hamlet"), ("4", None, "", "")], "id string, author string, uniform_title string, title string")
    hits = labels.select(F.col("hub_uri").alias("uri"), F.col("label").alias("aLabel"))
    got = {r["id"]: (r["hub_uri"], r["strategy"]) for r in R.label_cascade(records, labels, lambda q: R.suggest_search(q, hits, 1)).collect()}
    assert got == {"1": ("h1", "label_author_uniform"), "2": ("h3", "label_uniform"), "3": ("h1", "suggest_title"), "4": (None, "none")}
    q = spark.createDataFrame([("q", "a. ham")], "id string, query string")
    assert R.suggest_search(q, hits, 5, left_anchored=True).count() == 2
    assert R.suggest_search(q, hits, 5).count() == 0
    base = R.base_work(spark.createDataFrame([("k", "A. Hamlet. Russian"), ("l", "Faust")], "id string, aLabel string"), labels)
    assert [tuple(r) for r in base.collect()] == [("k", "h1")]


def test_legacy_prefers_typed(spark):
    edges = spark.createDataFrame([("a", "ns0__relatedTo", "b"), ("c", "ns0__translationOf", "a")], "source_uri string, edge_type string, target_uri string")
    typed = spark.createDataFrame([("a", f"{C.relationship_prefixes[1]}sequel", "b"), ("a", "bnode://1", "z")], "source_uri string, type_uri string, target_uri string")
    got = {(r["source_uri"], r["target_uri"]): r["rel_type"] for r in L.one_per_target(L.neighbours(edges, typed)).collect()}
    assert got == {("a", "b"): "sequel", ("b", "a"): "sequel_INBOUND", ("c", "a"): "ns0__translationOf", ("a", "c"): "ns0__translationOf_INBOUND"}


def test_answers_are_decoded_by_column_name(spark):
    answer = '{"results": [{"columns": ["n", "uri"], "data": [{"row": [3, "u"]}, {"row": [null, "v"]}]}], "errors": []}'
    df = spark.createDataFrame([(answer,), ('{"results": [], "errors": []}',)], "x string").select(F.inline(sinks.decode_rows(F.col("x"), ["uri", "n"])))
    assert [tuple(r) for r in df.collect()] == [("u", "3"), ("v", None)]


def test_posting_fails_on_bad_status(spark):
    df = spark.createDataFrame([(k,) for k in range(3)], "id int")
    sinks.post_batches(df, lambda body: 200)
    with pytest.raises(Exception, match="500"):
        sinks.post_batches(df, lambda body: 500)


def test_streamed_log(spark, tmp_path):
    rows = [(f"u{k % 3}", True, NOW + timedelta(minutes=k)) for k in range(9)]
    spark.createDataFrame(rows, cache_log.LOG).write.parquet(str(tmp_path / "in"))
    log = cache_log.first_within(cache_log.read(spark, str(tmp_path / "in")))
    cache_log.append(log, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = sinks.read_log(spark, str(tmp_path / "out"), F.lit(NOW + timedelta(hours=1)), 86_400)
    assert out.count() == 3


def test_cached_table(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("sequel", len(built))], "rel_type string, freq long")

    path = str(tmp_path / "freq")
    assert [sinks.cached_table(spark, path, build, ttl).first()["freq"] for ttl in (60, 60, 0)] == [1, 1, 2]


def test_a_commit_follows_all_batches(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(120)], "id int")
    log = tmp_path / "posts"
    log.mkdir()

    def post(body):
        (log / f"{abs(hash(body))}").write_text(body)
        return 200

    def commit():
        assert sum(len(json.loads(p.read_text())) for p in log.iterdir()) == 120
        assert all(len(json.loads(p.read_text())) <= 50 for p in log.iterdir())
        return 200

    sinks.post_batches(df, post, commit=commit)
    with pytest.raises(RuntimeError, match="503 to the commit"):
        sinks.post_batches(df, post, commit=lambda: 503)
    with pytest.raises(Exception, match="500"):
        sinks.post_batches(df, lambda body: 500, commit=lambda: pytest.fail("no commit after a failed batch"))


@pytest.mark.parametrize("answer, message", [("", "empty answer"), ("oops", "no answer"), ('{"results": [], "errors": [{"code": "Syntax", "message": "bad query"}]}', "Syntax: bad query")])
def test_wrong_answers_fail(spark, answer, message):
    df = spark.createDataFrame([(answer,)], "x string")
    with pytest.raises(Exception, match=message):
        df.select(sinks.decode_rows(F.col("x"), ["uri"])).collect()


def test_bucketed_table_needs_no_shuffle(spark):
    a = spark.range(100).select(F.col("id").cast("string").alias("hub_uri"))
    for name in ("bucketed_a", "bucketed_b"):
        sinks.write_bucketed(a, name, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "hub_uri")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().toString() and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE {name}")


def test_sources_prune_the_plan(spark):
    from kinweave.sources import fixture

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the test tables are not here")
    g = fixture.graph(spark, d)
    one = g.hub.orderBy("hub_uri").limit(3).select(F.col("hub_uri").alias("source_uri"))
    every = P.rank_related(g).join(one, "source_uri", "left_semi")
    columns = ["source_uri", "target_uri", "rank", "score", "title", "rel_type"]
    assert sorted(P.rank_related(g, one).select(*columns).collect()) == sorted(every.select(*columns).collect()) != []


def test_checkpoint_folder(spark, monkeypatch):
    """Only a session in a single process may go without a shared folder."""
    from kinweave import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                @staticmethod
                def get(key, default):
                    return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint(Frame())
    assert session.estimated_bytes(spark.range(1000)) == pytest.approx(8000, rel=0.01)
    assert session.estimated_bytes(spark.range(5_000_000)) > session.BROADCAST_LIMIT


def test_index_documents_have_their_schema(spark):
    from kinweave.model import INDEX_DOCUMENT
    from kinweave.sources import marc

    xml = "<record><controlfield tag='001'>7</controlfield><datafield tag='245' ind1=' ' ind2=' '><subfield code='a'>T</subfield></datafield></record>"
    df = spark.createDataFrame([(xml,)], "xml string").withColumn("marc", marc.from_column(F.col("xml")))
    want = {(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], INDEX_DOCUMENT).schema}
    doc = marc.index_document(df, "p")
    assert {(f.name, f.dataType.simpleString()) for f in doc.schema} == want and doc.first()["fullrecord"] == xml
    # Without the stored text the record is written again, and reads the same.
    again = marc.index_document(df.drop("xml"), "p").select(marc.from_column(F.col("fullrecord")).alias("m")).first()["m"]
    assert again["controlfield"][0]["_VALUE"] == "7" and again["datafield"][0]["subfield"][0]["_VALUE"] == "T"


def test_seed_only_when_the_index_is_empty(spark):
    """An index that holds anything is not seeded, and documents it holds are not loaded again."""
    from kinweave.sources import marc

    seeds = spark.createDataFrame([("s-1",), ("s-2",)], "id string")
    assert marc.seed(seeds, seeds.limit(0)).count() == 2 and marc.seed(seeds, spark.createDataFrame([("x",)], "id string")).count() == 0
    docs = spark.createDataFrame([("a-1",), ("a-2",)], "id string")
    assert marc.not_loaded(docs, docs.limit(0)).count() == 2 and marc.not_loaded(docs, docs).count() == 0
    assert marc.count_by_prefix(docs, "a").first()[0] == 2 and marc.count_by_prefix(docs, "b").first()[0] == 0


def test_sibling_search(spark):
    hubs = spark.createDataFrame([("h1", "A. Hamlet"), ("h2", "A. Hamlet. Russian"), ("h3", "B. Faust")], "uri string, aLabel string")
    got = R.siblings(spark.createDataFrame([("k", "A. Hamlet. Selections")], "id string, aLabel string"), hubs)
    assert {r["uri"] for r in got.collect()} == {"h1", "h2"}
    assert got.count() == 2


def test_verified_hits(spark):
    df = spark.createDataFrame([("1", [("u", (["12 34"],))], "1234"), ("2", [("u", (None,))], "1"), ("3", None, "1"), ("4", [("u", (["1"],))], None)], "id string, hits array<struct<uri string, more struct<identifiers array<string>>>>, lccn string")
    assert [r["v"] for r in df.select("id", R.verified(F.col("hits"), F.col("lccn")).alias("v")).orderBy("id").collect()] == [True, False, False, False]


def test_labels_that_are_asked_whole_need_no_beginnings(spark):
    """Of many hubs with one label only so many are looked at as are asked for, and only queries without enough equal labels are cut."""
    hits = spark.createDataFrame([(f"u{i}{k}", t) for i, t in enumerate(["Ab", "ab", "abc", "abcd", "İx"]) for k in range(3)], "uri string, aLabel string")
    queries = spark.createDataFrame([(q, q) for q in ["ab", "a", "abcd", "i̇", "zz", ""]], "id string, query string")
    got = R.suggest_search(queries, hits, 2, left_anchored=True)
    assert {tuple(r) for r in got.select("id", "position", "uri").collect()} == {("ab", 1, "u00"), ("ab", 2, "u01"), ("a", 1, "u00"), ("a", 2, "u01"), ("abcd", 1, "u30"), ("abcd", 2, "u31"), ("i̇", 1, "u40"), ("i̇", 2, "u41")}
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_million_keys_are_not_broadcast(spark, tmp_path):
    """A column of keys is small in its file, and its estimate with it; as text in a hash table it is not."""
    from kinweave import session

    spark.range(1_200_000).select("id", *[(F.col("id") % 7).alias(f"c{i}") for i in range(8)]).coalesce(1).write.parquet(str(tmp_path / "part"))
    uris = spark.read.parquet(str(tmp_path / "part")).select(F.concat(F.lit("http://example.org/hubs/"), "id").alias("uri"))
    joined = uris.join(session.broadcast_if_small(uris.select("uri")), "uri", "left_semi")
    assert session.estimated_bytes(uris) < 32 << 20
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_the_pipeline_repeats_no_step(spark):
    """Each step that is read more than once is written once: repeated, they fill the driver with the plan alone, at any size."""
    from kinweave.plans import resolve_queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the test tables are not here")
    for query in (resolve_queries.related_titles, resolve_queries.related_works):
        plan = query(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and plan.count("Join ") < 80


def test_neighbours_of_some_hubs(spark):
    """Both directions, with a relation to itself, one to no hub, blank types and none, with and without types written beside."""
    from kinweave.model import Graph, materialised

    names = lambda c, xs: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    relation = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "a", "a"), ("4", "a", "gone"), ("5", "c", "b"), ("6", "a", "c"), ("7", None, "a"), ("8", "c", "c")], "relation_id string, source_uri string, target_uri string")
    kind = spark.createDataFrame([("1", f"{C.relationship_prefixes[0]}sequel"), ("1", "bnode://x"), ("1", f"{C.relationship_prefixes[1]}partof"), ("5", "bnode://y"), ("3", f"{C.relationship_prefixes[0]}sequel")], "relation_id string, type_uri string")
    hub = names("hub_uri", "abc")
    g = Graph(hub, hub, hub, hub, hub, relation, kind)
    for graph in (g, materialised(g)):
        for some in ("a", "bc", "abc", "x"):
            one = names("source_uri", some)
            for sources in (names("source_uri", [*some, *some]), spark.range(1).select(F.explode(F.array(*map(F.lit, some))).alias("source_uri"))):  # by sieve and by broadcast
                got = G.neighbours_near(graph, sources).join(one, "source_uri", "left_semi").join(hub.withColumnRenamed("hub_uri", "source_uri"), "source_uri", "left_semi")
                want = G.neighbours(G.typed_relations(graph), one)
                assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_sieve_passes_every_key(spark):
    from kinweave import session

    keys = spark.range(5000).select(F.concat(F.lit("http://example.org/"), "id").alias("uri"))
    for most in (1 << 26, 64):
        test = session.sieve(keys.unionByName(spark.createDataFrame([(None,)], "uri string")), most)
        assert keys.filter(test(F.col("uri"))).count() == 5000
    others = spark.range(5000, 55000).select(F.concat(F.lit("http://example.org/"), "id").alias("uri"))
    assert others.filter(session.sieve(keys)(F.col("uri"))).count() < 5000
    assert others.filter(session.sieve(keys.limit(0))(F.col("uri"))).count() == 0
