"""Neighbours, frequencies, degrees and context of hubs; one plan answers for every hub asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.functions import exprs as X
from kinweave.model import Graph
from kinweave.session import BROADCAST_LIMIT, broadcast_if_small, estimated_bytes, sieve


def not_bnode(type_uri: Column) -> Column:
    return type_uri.isNull() | ~type_uri.startswith("bnode")


def between_hubs(graph: Graph, relation: DataFrame | None = None) -> DataFrame:
    """Relations whose both ends are hubs. A semi-join needs no distinct side, and a small one is broadcast."""
    hub, r = broadcast_if_small(graph.hub.select("hub_uri")), graph.relation if relation is None else relation
    return r.join(hub, r.source_uri == hub.hub_uri, "left_semi").join(hub, r.target_uri == hub.hub_uri, "left_semi")


def typed_relations(graph: Graph, config: Config = Config(), sources: DataFrame | None = None) -> DataFrame:
    """`source_uri, target_uri, rel_type` between hubs: one row per type, `related` without any, none when all are bnodes.

    With `sources(source_uri)` only relations that start or end at one of them are looked at, before any other join.
    """
    r = graph.relation if graph.typed is None else graph.typed
    if sources is not None:
        s = broadcast_if_small(sources.select(F.col("source_uri").alias("wanted")).distinct())
        out, back = r.join(s, r.source_uri == s.wanted, "left_semi"), r.join(s, r.target_uri == s.wanted, "left_semi")
        r = out.unionByName(back.join(s, back.source_uri == s.wanted, "left_anti"))
    t = between_hubs(graph, r)
    t = t.join(graph.relation_type, "relation_id", "left") if graph.typed is None else t.withColumn("type_uri", F.explode_outer("types"))
    t = t.filter(not_bnode(F.col("type_uri")))
    return t.select("source_uri", "target_uri", X.relation_slug(F.col("type_uri"), config).alias("rel_type"))


def outbound(relations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Neighbours along the relations; `sources(source_uri)` restricts whose."""
    r = relations.select("source_uri", "target_uri", "rel_type", F.lit(False).alias("is_direct"), F.lit(False).alias("is_inbound"))
    return r if sources is None else r.join(broadcast_if_small(sources.select("source_uri").distinct()), "source_uri", "left_semi")


def inbound(relations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Neighbours against the relations; their type ends in `_INBOUND`."""
    r = relations.select(
        F.col("target_uri").alias("source_uri"), F.col("source_uri").alias("target_uri"), F.concat("rel_type", F.lit(X.INBOUND)).alias("rel_type"), F.lit(False).alias("is_direct"), F.lit(True).alias("is_inbound")
    )
    return r if sources is None else r.join(broadcast_if_small(sources.select("source_uri").distinct()), "source_uri", "left_semi")


def neighbours(relations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All neighbours in both directions, with repeats.

    Both directions come from one pass over the relations, so their joins run once.
    """
    both = F.array(
        F.struct(F.col("source_uri"), F.col("target_uri"), F.col("rel_type"), F.lit(False).alias("is_inbound")),
        F.struct(F.col("target_uri").alias("source_uri"), F.col("source_uri").alias("target_uri"), F.concat("rel_type", F.lit(X.INBOUND)).alias("rel_type"), F.lit(True).alias("is_inbound")),
    )
    r = relations.select(F.inline(both)).select("source_uri", "target_uri", "rel_type", F.lit(False).alias("is_direct"), "is_inbound")
    return r if sources is None else r.join(broadcast_if_small(sources.select("source_uri").distinct()), "source_uri", "left_semi")


def neighbours_near(graph: Graph, sources: DataFrame, config: Config = Config()) -> DataFrame:
    """All neighbours in both directions of the hubs `sources(source_uri)`, with repeats, and some of those of others.

    For callers that join by source later and drop the others then: relations are turned round and thinned out before anything is
    joined, so the first shuffle is by target and serves the hubs, `one_per_target` and the target's context.
    """
    r, kept = (graph.relation, ["relation_id"]) if graph.typed is None else (graph.typed, ["types"])
    ends = lambda a, b, inbound: F.struct(F.col(a).alias("source_uri"), F.col(b).alias("target_uri"), F.lit(inbound).alias("is_inbound"))
    both = r.select(*kept, F.inline(F.array(ends("source_uri", "target_uri", False), ends("target_uri", "source_uri", True))))
    if estimated_bytes(sources) <= BROADCAST_LIMIT:
        t = both.join(F.broadcast(sources.select("source_uri").distinct()), "source_uri", "left_semi")
    else:
        t = both.filter(sieve(sources.select("source_uri"))(F.col("source_uri")))
    hub = broadcast_if_small(graph.hub.select("hub_uri"))
    t = t.join(hub, t.target_uri == hub.hub_uri, "left_semi")
    t = t.join(graph.relation_type, "relation_id", "left") if graph.typed is None else t.withColumn("type_uri", F.explode_outer("types"))
    slug = X.relation_slug(F.col("type_uri"), config)
    rel_type = F.when(F.col("is_inbound"), F.concat(slug, F.lit(X.INBOUND))).otherwise(slug)
    return t.filter(not_bnode(F.col("type_uri"))).select("source_uri", "target_uri", rel_type.alias("rel_type"), F.lit(False).alias("is_direct"), "is_inbound")


def one_per_target(related: DataFrame) -> DataFrame:
    """One row per source and target: a specific type before one that begins with `related`, outbound before inbound, then by type.

    A minimum over a struct combines on the map side; a window would sort every neighbour.
    """
    rank = F.struct(F.col("rel_type").startswith("related").alias("generic"), "is_inbound", "rel_type", "is_direct")
    best = related.groupBy("source_uri", "target_uri").agg(F.min(rank).alias("b"))
    return best.select("source_uri", "target_uri", "b.rel_type", "b.is_direct", "b.is_inbound")


def type_frequencies(graph: Graph, config: Config = Config()) -> DataFrame:
    """`rel_type, freq`: how often each type is used, by relations to anything. As many rows as there are types."""
    t = graph.relation_type.filter(F.col("type_uri").isNotNull() & not_bnode(F.col("type_uri")))
    return t.groupBy(X.relation_slug(F.col("type_uri"), config).alias("rel_type")).agg(F.count(F.lit(1)).alias("freq"))


def degrees(graph: Graph) -> DataFrame:
    """`hub_uri, out_rels, in_rels` of every hub, over relations between hubs; each side is counted on its own."""
    hub = graph.hub.select("hub_uri").distinct()
    ends = between_hubs(graph).select(F.inline(F.array(F.struct(F.col("source_uri").alias("hub_uri"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_uri").alias("hub_uri"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    n = ends.groupBy("hub_uri").agg(F.sum("o").alias("out_rels"), F.sum("i").alias("in_rels"))
    zero = F.lit(0).cast("long")
    return hub.join(n, "hub_uri", "left").select("hub_uri", F.coalesce("out_rels", zero).alias("out_rels"), F.coalesce("in_rels", zero).alias("in_rels"))


def hub_context(graph: Graph, wanted: DataFrame | None = None) -> DataFrame:
    """`hub_uri, title, agents, media` of every hub, or of the `wanted(hub_uri)`.

    Titles, agents and types are each collected before they are joined. The title is the smallest first title of the hub's
    title nodes; agents and media are sorted sets, empty when there are none.
    """
    w = None if wanted is None else broadcast_if_small(wanted.select("hub_uri").distinct())
    of = lambda df: df if w is None else df.join(w, "hub_uri", "left_semi")
    hub = of(graph.hub.select("hub_uri")).distinct()
    title = of(graph.title).groupBy("hub_uri").agg(F.min(F.get("main_titles", F.lit(0))).alias("title"))
    agents = of(graph.agent).groupBy("hub_uri").agg(F.sort_array(F.collect_set("agent_uri")).alias("agents"))
    media = of(graph.type).groupBy("hub_uri").agg(F.sort_array(F.collect_set("type_uri")).alias("media"))
    none = F.array().cast("array<string>")
    c = hub.join(title, "hub_uri", "left").join(agents, "hub_uri", "left").join(media, "hub_uri", "left")
    return c.select("hub_uri", "title", F.coalesce("agents", none).alias("agents"), F.coalesce("media", none).alias("media"))


def title_contains(graph: Graph, text: str) -> DataFrame:
    """Hubs any of whose titles contains a text, whatever its case."""
    return graph.title.filter(F.exists("main_titles", lambda t: F.contains(F.lower(t), F.lit(text.lower())))).select("hub_uri").distinct()
