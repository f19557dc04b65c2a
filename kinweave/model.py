"""Schemas of the tables, and the graph as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import checkpoint

#: Stored MARC records as the XML reader gives them.
MARC = """leader string, controlfield array<struct<_tag string, _VALUE string>>,
 datafield array<struct<_tag string, _ind1 string, _ind2 string, subfield array<struct<_code string, _VALUE string>>>>"""
#: What one hub's RDF holds.
PARSED_RDF = """uri string, title string, agents array<string>, media array<string>,
 relations array<struct<targetUri string, relType string, title string, isDirect boolean>>"""
#: One index document, as `kinweave.sources.marc.index_document` makes it.
INDEX_DOCUMENT = """id string, title string, title_short string, title_full string, title_sort string, title_auth string, author string, author_sort string,
 format array<string>, record_format string, language array<string>, publishDate array<string>, fullrecord string"""
TRIPLE = "s string, p string, o string, o_is_iri boolean, lang string"


@dataclass(frozen=True)
class Graph:
    """The bibliographic graph. Each field is a table with a fixed schema.

    hub(hub_uri); title(hub_uri, title_node, main_titles array<string>); agent(hub_uri, agent_uri); type(hub_uri, type_uri);
    identifier(hub_uri, id_value); relation(relation_id, source_uri, target_uri); relation_type(relation_id, type_uri).
    `typed`, where there is one, holds relation and relation_type together, written once, so that nothing joins them again:
    (relation_id, source_uri, target_uri, types array<string>), with an empty array for a relation without a type.
    """

    hub: DataFrame
    title: DataFrame
    agent: DataFrame
    type: DataFrame
    identifier: DataFrame
    relation: DataFrame
    relation_type: DataFrame
    typed: DataFrame | None = None


def materialised(graph: Graph) -> Graph:
    """The graph with its relations and their types in one written table, for plans that read them more than once."""
    kinds = graph.relation_type.groupBy("relation_id").agg(F.collect_set("type_uri").alias("types"))
    none = F.array().cast("array<string>")
    typed = graph.relation.join(kinds, "relation_id", "left").select("relation_id", "source_uri", "target_uri", F.coalesce("types", none).alias("types"))
    return with_typed(graph, checkpoint(typed))


def with_typed(graph: Graph, typed: DataFrame) -> Graph:
    """The graph whose relations and types are those of the written table `typed`."""
    return replace(graph, relation=typed.select("relation_id", "source_uri", "target_uri"), relation_type=typed.select("relation_id", F.explode("types").alias("type_uri")), typed=typed)
