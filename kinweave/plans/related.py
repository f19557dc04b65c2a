"""Whole pipelines: from records to their related works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.config import Config
from kinweave.model import Graph
from kinweave.operators import graph as G
from kinweave.operators import scoring as S
from kinweave.operators import validation as V
from kinweave.session import BROADCAST_LIMIT, broadcast_rows, checkpoint, estimated_bytes
from kinweave.sources import rdfxml


def rank_related(graph: Graph, sources: DataFrame | None = None, n: int | None = None, config: Config = Config(), freq: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Related hubs of every hub, or of `sources(source_uri)`, scored and ranked from the graph.

    With `sources`, relations are restricted to what they touch before anything else; contexts too, if the sources are few: for
    many the context of every hub is less than a second pass over their neighbours. Scores equal to nine decimals are ranked by
    target. `freq` are the graph's `frequencies`, where they are known already. The columns of `marks(target_uri, ...)` are added,
    where the neighbours lie together by target anyway.
    """
    wanted = None
    if sources is None:
        related = G.one_per_target(G.neighbours(G.typed_relations(graph, config)))
    else:
        small = estimated_bytes(sources) <= BROADCAST_LIMIT
        sources = sources.select("source_uri").distinct()
        sources = sources.join(graph.hub.select(F.col("hub_uri").alias("source_uri")), "source_uri", "left_semi")
        related = G.one_per_target(G.neighbours_near(graph, sources, config))
        if small:
            wanted = related.select(F.explode(F.array("source_uri", "target_uri")).alias("hub_uri")).distinct()
    related = related if marks is None else related.join(marks, "target_uri", "left")
    # Agents are only compared, so their hashes do.
    context = G.hub_context(graph, wanted).withColumn("agents", F.transform("agents", lambda a: F.hex(F.xxhash64(a))))
    scored = S.score(related, context, frequencies(graph, config) if freq is None else freq, config).withColumn("score", F.round("score", 9))
    # Here the rows lie together by source. An inner join, as a semi-join would be moved before the first shuffle.
    scored = scored if sources is None else scored.join(sources, "source_uri")
    return S.ranked(scored) if n is None else S.top(scored, n)


def frequencies(graph: Graph, config: Config = Config()) -> DataFrame:
    return G.type_frequencies(graph, config)


def rank_from_rdf(parsed: DataFrame, graph: Graph, config: Config = Config(), freq: DataFrame | None = None) -> DataFrame:
    """Related hubs as the hubs' own RDF states them; the targets' context comes from the graph, the sources' from the RDF."""
    rel = rdfxml.dedup_relations(rdfxml.relations(parsed)).withColumn("is_inbound", F.lit(False))
    none = F.array().cast("array<string>")
    own = parsed.select(F.col("uri").alias("hub_uri"), "title", F.coalesce("agents", none).alias("agents"), F.coalesce("media", none).alias("media"))
    context = G.hub_context(graph, rel.select(F.col("target_uri").alias("hub_uri")).distinct())
    scored = S.score(rel, context, frequencies(graph, config) if freq is None else freq, config, source_context=own)
    titles = rdfxml.relations(parsed).groupBy("source_uri", "target_uri").agg(F.min_by("title", "seq").alias("rdf_title"))
    return S.ranked(scored.join(titles, ["source_uri", "target_uri"], "left").withColumn("title", F.coalesce("rdf_title", "title")).drop("rdf_title"))


def first_candidate(candidates: DataFrame) -> DataFrame:
    """Rows `id, priority, ...` of each record's best candidate that has any: the smallest priority wins."""
    best = candidates.groupBy("id").agg(F.min("priority").alias("best"))
    return candidates.join(best.withColumnRenamed("id", "b_id"), (F.col("id") == F.col("b_id")) & (F.col("priority") == F.col("best"))).drop("b_id", "best")


def primaries(candidates: DataFrame, records: DataFrame, graph: Graph, rdf_titles: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """`id, source_uri, primary_uri, hub_title` of each candidate hub `id, source_uri, source`; see `related_works`."""
    own = F.col("title") if "title" in records.columns else F.lit(None).cast("string")
    heads = candidates.select("id", "source_uri", "source").join(records.select("id", own.alias("own_title")).distinct(), "id")
    graph_titles = graph.title.groupBy("hub_uri").agg(F.min(F.get("main_titles", F.lit(0))).alias("graph_title"))
    heads = heads.join(graph_titles.withColumnRenamed("hub_uri", "source_uri"), "source_uri", "left")
    if rdf_titles is not None:
        heads = heads.join(rdf_titles.groupBy("source_uri").agg(F.first("rdf_title").alias("rdf_title")), "source_uri", "left")
    else:
        heads = heads.withColumn("rdf_title", F.lit(None).cast("string"))
    title = F.coalesce(F.when(F.col("source") == "rdf", F.col("rdf_title")), "own_title", "graph_title")
    heads = heads.groupBy("id", "source_uri").agg(F.first(title).alias("hub_title")).withColumn("hub_uri", F.col("source_uri"))
    heads = heads if valid is None else V.valid_primary(heads, valid)
    return heads.select("id", "source_uri", F.col("hub_uri").alias("primary_uri"), "hub_title")


def new_negatives(payloads: DataFrame, as_of: Column, config: Config = Config()) -> DataFrame:
    """`uri, checked_at` to append to the negative log: hubs that were served readable RDF without relations; no failed reads."""
    return V.found_empty(rdfxml.parse(rdfxml.usable(payloads), config), as_of)


def related_works(records: DataFrame, graph: Graph, payloads: DataFrame | None = None, negative: DataFrame | None = None, log: DataFrame | None = None, as_of: Column | None = None, config: Config = Config()) -> DataFrame:
    """Related works of resolved records `id, hub_uri, suggested_uri, base_uri`.

    A record's own hub is tried by its RDF first, then the suggested hub's RDF, the base work's RDF, and at last the graph
    for the suggested and for the own hub; the first that has results wins. `source` tells which. `primary_uri` is that hub,
    and `hub_title` its title: the one its RDF states if that was used, else the record's own `title`, if `records` has that
    column, else the graph's. With a log of checks only valid results are shown, their number is capped, and a primary hub
    that is not valid is null while its results stay.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    wanted = records.select("id", F.posexplode(F.array("hub_uri", "suggested_uri", "base_uri")).alias("k", "source_uri")).filter("source_uri <> ''")
    valid = None if log is None else V.valid_uris(log, as_of, config.validation_ttl)
    freq = broadcast_rows(frequencies(graph, config), S.MAX_TYPES)[0]
    order = F.when(F.col("k") == 1, 3).when(F.col("k") == 0, 4)
    from_graph = wanted.filter("k < 2").select("id", order.alias("priority"), "source_uri").groupBy("id", "source_uri").agg(F.min("priority").alias("priority"))
    candidates, parsed, rdf_titles = from_graph.withColumn("source", F.lit("graph")), None, None
    if payloads is not None:
        body = rdfxml.usable(payloads)
        if negative is not None:
            body = V.skip_known_empty(body, negative, as_of, config.empty_rdf_ttl)
        body = body.join(wanted.select(F.col("source_uri").alias("hub_uri")).distinct(), "hub_uri", "left_semi")
        # Each step that is read more than once is written once: a plan that repeats them takes the driver's memory at any size.
        parsed = checkpoint(rdfxml.parse(body, config))
        rdf_titles = parsed.select(F.col("uri").alias("source_uri"), F.col("title").alias("rdf_title"))
        # RDF with any relation has results, so which hub wins is known before anything is scored.
        some = parsed.filter(F.size("relations") > 0).select(F.col("uri").alias("source_uri")).distinct()
        found = wanted.join(some, "source_uri").groupBy("id").agg(F.min(F.struct("k", "source_uri")).alias("b"))
        found = found.select("id", "b.source_uri", F.col("b.k").alias("priority"))
        candidates = candidates.join(found, "id", "left_anti").unionByName(found.withColumn("source", F.lit("rdf")))
    heads = primaries(candidates, records, graph, rdf_titles, valid if config.validate_uris else None)
    candidates = checkpoint(candidates.join(heads, ["id", "source_uri"]))
    columns = ["source_uri", "target_uri", "title", "rel_type", "label", "tier", "score", "rank", "media", "different_author"]
    checked = valid is not None and config.validate_uris
    chosen = candidates.filter("source = 'graph'")
    sources = checkpoint(from_graph.select("source_uri").distinct().join(chosen.select("source_uri"), "source_uri", "left_semi"))
    marks = valid.select(F.col("uri").alias("target_uri"), F.lit(True).alias("ok")) if checked else None
    ranked = rank_related(graph, sources, config=config, freq=freq, marks=marks)
    ranked = ranked.withColumn("ok", F.coalesce("ok", F.lit(False))) if checked else ranked.withColumn("ok", F.lit(True))
    # All results of a record come from one hub, so what is shown is the same for each of its records, and cut before they are told apart.
    if checked:
        cut = Window.partitionBy("source_uri", "seen").orderBy("rank")
        seen = (F.col("rank") <= max(10, 3 * config.max_display)) & (F.col("target_uri") != "") & F.col("ok")
        ranked = ranked.withColumn("seen", seen).withColumn("shown_rank", F.row_number().over(cut))
        # The first result stays, as it tells that there are any.
        ranked = ranked.filter((F.col("rank") == 1) | F.col("seen") & (F.col("shown_rank") <= config.max_display))
    else:
        ranked = ranked.withColumns({"seen": F.lit(True), "shown_rank": F.col("rank")})
    best = chosen.join(ranked.select(*columns, "seen", "shown_rank"), "source_uri")
    # The suggested hub before the own one: a window, as a join would repeat the whole ranking.
    best = best.withColumn("best", F.min("priority").over(Window.partitionBy("id"))).filter("priority = best AND seen").drop("best", "seen")
    if checked:
        best = best.filter(F.col("shown_rank") <= config.max_display)
    if parsed is None:
        return best
    chosen = candidates.filter("source = 'rdf'")
    used = parsed.join(chosen.select(F.col("source_uri").alias("uri")), "uri", "left_semi")
    stated = chosen.join(rank_from_rdf(used, graph, config, freq).select(*columns), "source_uri")
    if checked:
        stated = V.looked_up(stated, config).join(valid.select(F.col("uri").alias("target_uri")), "target_uri", "left_semi")
    # Two records may share a hub, so results are shown per record.
    return best.unionByName(V.kept(stated, config, "id") if checked else stated.withColumn("shown_rank", F.col("rank")))
