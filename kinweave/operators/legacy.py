"""The older graph model with its own scoring, for comparison with the present one.

Hubs are linked by direct edges `source_uri, edge_type, target_uri` and by typed relations `source_uri, type_uri, target_uri`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.functions import exprs as X
from kinweave.operators.scoring import MAX_TYPES, with_context
from kinweave.session import broadcast_rows

# Tiers of direct edges, and listed types that the older lists lack.
DIRECT_TIERS = {"ns0__translationOf": 5, "ns0__relatedTo": 3, "ns0__arrangementOf": 4}
_UNLISTED = ("musicaltheatreadaptionof", "preceededby")


def neighbours(edges: DataFrame, typed: DataFrame, config: Config = Config()) -> DataFrame:
    """The four patterns: direct out, direct in (except `ns0__relatedTo`), typed out, typed in; with their order `seq`."""
    t = typed.filter(~F.col("type_uri").startswith("bnode")).withColumn("rel_type", F.replace("type_uri", F.lit(config.relationship_prefixes[1])))
    flip = lambda df, c: df.select(F.col("target_uri").alias("source_uri"), F.col("source_uri").alias("target_uri"), F.concat(c, F.lit(X.INBOUND)).alias("rel_type"))
    parts = [
        edges.select("source_uri", "target_uri", F.col("edge_type").alias("rel_type")), flip(edges.filter("edge_type <> 'ns0__relatedTo'"), "edge_type"),
        t.select("source_uri", "target_uri", "rel_type"), flip(t, "rel_type"),
    ]
    out = None
    for k, p in enumerate(parts):
        p = p.select("source_uri", "target_uri", "rel_type", F.lit(k < 2).alias("is_direct"), F.lit(k).alias("seq"))
        out = p if out is None else out.unionByName(p)
    return out


def one_per_target(related: DataFrame) -> DataFrame:
    """Typed relations before direct edges, then in the order of the patterns, then by type."""
    b = related.groupBy("source_uri", "target_uri").agg(F.min(F.struct("is_direct", "seq", "rel_type")).alias("b"))
    return b.select("source_uri", "target_uri", "b.rel_type", "b.is_direct")


def degree(edges: DataFrame) -> DataFrame:
    """`hub_uri, rel_count` by outgoing direct edges."""
    return edges.groupBy(F.col("source_uri").alias("hub_uri")).agg(F.count(F.lit(1)).alias("rel_count"))


def candidates(title: DataFrame, edges: DataFrame, text: str, n: int = 10) -> DataFrame:
    """`hub_uri, rel_count`: of the hubs any of whose titles contains a text, whatever its case, the `n` with most direct edges."""
    held = title.filter(F.exists("main_titles", lambda t: F.contains(F.lower(t), F.lit(text.lower())))).select("hub_uri").distinct()
    return held.join(degree(edges), "hub_uri").orderBy(F.desc("rel_count"), "hub_uri").limit(n)


def score(related: DataFrame, context: DataFrame, frequencies: DataFrame, total: int, config: Config = Config()) -> DataFrame:
    """Adds `tier, base, rarity_bonus, author_bonus, medium_bonus, score`; media bring 10 when they differ at all."""
    f, _ = broadcast_rows(frequencies.select(F.col("rel_type").alias("f_type"), "freq"), MAX_TYPES)
    j = related.withColumn("slug", X.clean_type(F.col("rel_type")))
    j = j.join(f, j.slug == f.f_type, "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
    j = with_context(with_context(j, context, "source", "source_uri"), context, "target", "target_uri")
    bare = F.replace("rel_type", F.lit(X.INBOUND))
    tier = X.tier(F.when(~F.col("slug").isin(*_UNLISTED), F.col("slug")).otherwise(F.lit("")))
    direct = F
    for k, v in DIRECT_TIERS.items():
        direct = direct.when(F.col("is_direct") & (bare == k), v)
    sm, tm = X.specific_media(F.col("source_media"), config), X.specific_media(F.col("target_media"), config)
    differ = F.sort_array(sm) != F.sort_array(tm)
    medium = F.when((F.size(sm) > 0) & (F.size(tm) > 0) & differ, 10.0).when((F.size(sm) == 0) & (F.size(tm) > 0), 8.0).when((F.size(sm) > 0) & (F.size(tm) == 0), 3.0).otherwise(0.0)
    j = j.withColumn("tier", direct.otherwise(tier)).withColumns(
        {"base": X.base_score(F.col("tier")), "rarity_bonus": X.rarity_bonus(F.col("freq"), F.lit(total)), "author_bonus": X.author_bonus(F.col("source_agents"), F.col("target_agents")), "medium_bonus": medium}
    )
    return j.withColumn("score", X.clamp(F.col("base") + F.col("rarity_bonus") + F.col("author_bonus") + F.col("medium_bonus")))
