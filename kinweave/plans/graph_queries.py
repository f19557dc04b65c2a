"""Queries over the bibliographic graph: neighbours, frequencies, context, scores, ranks and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.functions import exprs as X
from kinweave.operators import graph as G
from kinweave.operators import scoring as S
from kinweave.plans import graph_sql as Q
from kinweave.plans import related as P
from kinweave.session import read
from kinweave.sources import fixture, sinks

_C = Config()


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return G.typed_relations(fixture.graph(spark, d))


def neighbours_out(spark: SparkSession, d: str) -> DataFrame:
    return G.outbound(_relations(spark, d))


def neighbours_in(spark: SparkSession, d: str) -> DataFrame:
    return G.inbound(_relations(spark, d))


def neighbours_union(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(_relations(spark, d))


def neighbours_dedup(spark: SparkSession, d: str) -> DataFrame:
    return G.one_per_target(G.neighbours(_relations(spark, d)))


def rel_type_frequency(spark: SparkSession, d: str) -> DataFrame:
    return G.type_frequencies(fixture.graph(spark, d))


def hub_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(fixture.graph(spark, d))


def hub_context(spark: SparkSession, d: str) -> DataFrame:
    return G.hub_context(fixture.graph(spark, d))


def title_contains(spark: SparkSession, d: str) -> DataFrame:
    return G.title_contains(fixture.graph(spark, d), "RED")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    g = fixture.graph(spark, d, keep=True)
    related = G.one_per_target(G.neighbours(G.typed_relations(g)))
    return S.score(related, G.hub_context(g), G.type_frequencies(g)).withColumn("score", F.round("score", 9))


def tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = rel_type_frequency(spark, d)
    return f.select("rel_type", X.tier(F.col("rel_type")).alias("tier"), X.base_score(X.tier(F.col("rel_type"))).alias("base"))


def rarity_bonus(spark: SparkSession, d: str) -> DataFrame:
    f = rel_type_frequency(spark, d)
    return f.select("rel_type", F.round(X.rarity_bonus(F.col("freq"), f.agg(F.max("freq")).scalar()), 6).alias("rarity"))


def author_distance(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("author_bonus", "different_author").agg(F.count(F.lit(1)).alias("n_pairs"))


def medium_crossing(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("medium_bonus").agg(F.count(F.lit(1)).alias("n_pairs"))


def surprise_score(spark: SparkSession, d: str) -> DataFrame:
    parts = ("tier", "base", F.round("rarity_bonus", 6).alias("rarity_bonus"), "author_bonus", "medium_bonus")
    return _scored(spark, d).select("source_uri", "target_uri", "rel_type", *parts, F.round("score", 6).alias("score"))


def rank_related(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the ten most surprising related hubs of every hub, with their parts."""
    t = P.rank_related(fixture.graph(spark, d, keep=True), n=10)
    return t.select("source_uri", "rank", "target_uri", "title", "rel_type", "label", F.round("score", 6).alias("score"), "tier", "different_author")


def all_ranked(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked(_scored(spark, d)).select("source_uri", "target_uri", "rank", F.round("score", 6).alias("score"))


def group_by_label(spark: SparkSession, d: str) -> DataFrame:
    g = S.grouped(S.ranked(_scored(spark, d)))
    return g.select("source_uri", "label", F.round("top_score", 6).alias("top_score"), "tier", "n_results", "expanded", "group_rank", F.array_join(F.transform("results", lambda r: r["target_uri"]), "|").alias("targets"))


def grouped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every result with its group and the group's place among its source's groups."""
    r = S.grouped_rows(S.ranked(_scored(spark, d)))
    return r.select("source_uri", "target_uri", "label", "group_rank", "group_tier", "n_results", "expanded", "rank")


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(_scored(spark, d))


def display_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.display(_scored(spark, d))


def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every score as shown."""
    return _scored(spark, d).select("source_uri", "target_uri", S.breakdown().alias("b")).select("source_uri", "target_uri", "b.*")


def ranked_report(spark: SparkSession, d: str) -> DataFrame:
    """The text lines of every hub's ten best results."""
    return sinks.report(P.rank_related(fixture.graph(spark, d, keep=True), n=10)).select("source_uri", "rank", "line")


def related_of_some(spark: SparkSession, d: str) -> DataFrame:
    """Related hubs of the hubs of one brand only, by the pruned plan."""
    some = read(spark, d, "part").filter("p_brand = 'Brand#11'").select(fixture.hub_uri(F.col("p_partkey"), _C).alias("source_uri"))
    t = P.rank_related(fixture.graph(spark, d, keep=True), some)
    return t.select("source_uri", "target_uri", "rank", "title", F.round("score", 6).alias("score"))


def label_fallback(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours_union(spark, d).select("rel_type").distinct()
    return n.select("rel_type", X.label(F.col("rel_type")).alias("label"))


def best_connected_hub(spark: SparkSession, d: str) -> DataFrame:
    """Of the hubs that share a first title, the one with the most relations."""
    g = fixture.graph(spark, d)
    t = g.title.select("hub_uri", F.get("main_titles", F.lit(0)).alias("title"))
    n = G.degrees(g).select("hub_uri", (F.col("out_rels") + F.col("in_rels")).alias("rels"))
    best = t.join(n, "hub_uri").groupBy("title").agg(F.min(F.struct((-F.col("rels")).alias("r"), "hub_uri")).alias("b"))
    return best.select("title", "b.hub_uri", (-F.col("b.r")).alias("rels"))


QUERIES = {
    f.__name__: f
    for f in (
        neighbours_out, neighbours_in, neighbours_union, neighbours_dedup, rel_type_frequency, hub_degree, hub_context, title_contains, tier_lookup, rarity_bonus, author_distance, medium_crossing,
        surprise_score, rank_related, all_ranked, group_by_label, grouped_rows, score_summary, display_rows, score_breakdown, ranked_report, related_of_some, label_fallback, best_connected_hub,
    )
}

_NB = "source_uri, target_uri, rel_type, is_direct, is_inbound"
SQL = {
    "neighbours_out": f"WITH {Q.GRAPH} SELECT {_NB} FROM nb WHERE NOT is_inbound",
    "neighbours_in": f"WITH {Q.GRAPH} SELECT {_NB} FROM nb WHERE is_inbound",
    "neighbours_union": f"WITH {Q.GRAPH} SELECT {_NB} FROM nb",
    "neighbours_dedup": f"WITH {Q.GRAPH} SELECT {_NB} FROM one",
    "rel_type_frequency": f"WITH {Q.GRAPH} SELECT * FROM freq",
    "hub_degree": f"WITH {Q.GRAPH} SELECT * FROM deg",
    "hub_context": f"WITH {Q.GRAPH} SELECT * FROM ctx",
    "title_contains": f"WITH {Q.GRAPH} SELECT DISTINCT hub_uri FROM g_title WHERE len(list_filter(main_titles, lambda t: contains(lower(t), 'red'))) > 0",
    "tier_lookup": f"WITH {Q.GRAPH}, t AS (SELECT rel_type, {Q.tier('rel_type')} AS tier FROM freq) SELECT rel_type, tier, {Q._BASE.format(t='tier')} AS base FROM t",
    "rarity_bonus": f"WITH {Q.GRAPH}, m AS (SELECT max(freq) AS m FROM freq) SELECT rel_type, round({Q.rarity('freq', 'm')}, 6) AS rarity FROM freq, m",
    "author_distance": f"WITH {Q.SCORED} SELECT author_bonus, different_author, count(*) AS n_pairs FROM scored GROUP BY ALL",
    "medium_crossing": f"WITH {Q.SCORED} SELECT medium_bonus, count(*) AS n_pairs FROM scored GROUP BY ALL",
    "surprise_score": f"WITH {Q.SCORED} SELECT source_uri, target_uri, rel_type, tier, base, round(rarity_bonus, 6) AS rarity_bonus, author_bonus, medium_bonus, round(score, 6) AS score FROM scored",
    "rank_related": f"WITH {Q.SCORED} SELECT source_uri, rank, target_uri, title, rel_type, {Q.label('rel_type')} AS label, round(score, 6) AS score, tier, different_author FROM ranked WHERE rank <= 10",
    "all_ranked": f"WITH {Q.SCORED} SELECT source_uri, target_uri, rank, round(score, 6) AS score FROM ranked",
    "group_by_label": f"""WITH {Q.SCORED}, x AS (SELECT *, {Q.label('rel_type')} AS label FROM ranked)
        SELECT source_uri, label, round(max(score), 6) AS top_score, arg_min(tier, rank) AS tier, count(*) AS n_results, arg_min(tier, rank) <= 2 AS expanded, string_agg(target_uri, '|' ORDER BY rank) AS targets,
        row_number() OVER (PARTITION BY source_uri ORDER BY round(max(score), 9) DESC, label) AS group_rank FROM x GROUP BY source_uri, label""",
    "grouped_rows": f"""WITH {Q.SCORED}, {Q.LABEL_TABLE}, b AS (SELECT *, regexp_replace({Q.clean('rel_type')}, '^ns[0-9]+__', '') AS bare FROM ranked),
        x AS (SELECT b.*, coalesce(lbl.label, {Q.made_label('bare')}) AS label FROM b LEFT JOIN lbl ON lbl.slug = b.bare),
        g AS (SELECT source_uri, label, arg_min(tier, rank) AS group_tier, count(*) AS n_results, row_number() OVER (PARTITION BY source_uri ORDER BY round(max(score), 9) DESC, label) AS group_rank FROM x GROUP BY source_uri, label)
        SELECT x.source_uri, x.target_uri, x.label, g.group_rank, g.group_tier, g.n_results, g.group_tier <= 2 AS expanded, x.rank FROM x JOIN g ON x.source_uri = g.source_uri AND x.label = g.label""",
    "score_summary": f"WITH {Q.SCORED} SELECT source_uri, count(*) AS n_related, count(*) FILTER (score >= 50) AS n_interesting, count(*) FILTER (score < 20) AS n_low FROM scored GROUP BY 1",
    "display_rows": f"""WITH {Q.SCORED}, {Q.LABEL_TABLE}, b AS (SELECT *, regexp_replace({Q.clean('rel_type')}, '^ns[0-9]+__', '') AS bare FROM scored)
        SELECT source_uri, target_uri, coalesce(title, 'Unknown') AS title, array_to_string(media, ', ') AS media, coalesce(lbl.label, {Q.made_label('bare')}) AS label, different_author FROM b LEFT JOIN lbl ON lbl.slug = b.bare""",
    "score_breakdown": f"""WITH {Q.SCORED} SELECT source_uri, target_uri, tier, base, round(rarity_bonus + 1e-9, 1) AS "rarityBonus", author_bonus AS "authorBonus", medium_bonus AS "mediumBonus" FROM scored""",
    "ranked_report": f"""WITH {Q.SCORED}, {Q.LABEL_TABLE}, b AS (SELECT *, regexp_replace({Q.clean('rel_type')}, '^ns[0-9]+__', '') AS bare FROM ranked WHERE rank <= 10)
        SELECT source_uri, rank, lpad(rank::VARCHAR, 2, ' ') || '. ' || rpad(coalesce(title, 'Unknown')[1:40], 40, ' ') || ' ' || rpad(coalesce(lbl.label, {Q.made_label('bare')})[1:24], 24, ' ')
          || ' ' || lpad(printf('%.1f', round(score + 1e-9, 1)), 6, ' ') AS line FROM b LEFT JOIN lbl ON lbl.slug = b.bare""",
    "related_of_some": f"WITH {Q.SCORED} SELECT source_uri, target_uri, rank, title, round(score, 6) AS score FROM ranked WHERE source_uri IN (SELECT '{Q._H}' || p_partkey FROM part WHERE p_brand = 'Brand#11')",
    "label_fallback": f"WITH {Q.GRAPH}, n AS (SELECT DISTINCT rel_type FROM nb) SELECT rel_type, {Q.label('rel_type')} AS label FROM n",
    "best_connected_hub": f"""WITH {Q.GRAPH}, t AS (SELECT main_titles[1] AS title, g_title.hub_uri, out_rels + in_rels AS rels FROM g_title JOIN deg ON g_title.hub_uri = deg.hub_uri)
        SELECT title, hub_uri, rels FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY rels DESC, hub_uri) AS rn FROM t) WHERE rn = 1""",
}
