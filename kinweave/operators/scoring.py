"""Scores, ranks and groups of related hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.config import Config
from kinweave.functions import exprs as X
from kinweave.session import broadcast_rows

_NONE = "array<string>"
#: Most relation types whose frequencies are broadcast.
MAX_TYPES = 100_000


def with_context(related: DataFrame, context: DataFrame, prefix: str, key: str) -> DataFrame:
    """Joins title, agents and media of one side; a hub without context has none of them."""
    c = context.select(F.col("hub_uri").alias(f"{prefix}_key"), *[F.col(x).alias(f"{prefix}_{x}") for x in ("title", "agents", "media")])
    j = related.join(c, related[key] == c[f"{prefix}_key"], "left").drop(f"{prefix}_key")
    for x in ("agents", "media"):
        j = j.withColumn(f"{prefix}_{x}", F.coalesce(f"{prefix}_{x}", F.array().cast(_NONE)))
    return j


def score(related: DataFrame, context: DataFrame, frequencies: DataFrame, config: Config = Config(), source_context: DataFrame | None = None) -> DataFrame:
    """Adds title, label, score, its parts, media and `different_author` to `related(source_uri, target_uri, rel_type, ...)`.

    Frequencies have as many rows as there are types; up to `MAX_TYPES` of them are counted once and broadcast. Without any
    frequency every type counts as unknown.
    """
    f, rows = broadcast_rows(frequencies.select(F.col("rel_type").alias("f_type"), "freq"), MAX_TYPES)
    top = frequencies.agg(F.coalesce(F.max("freq"), F.lit(1))).scalar() if rows is None else F.lit(max((r["freq"] for r in rows), default=1)).cast("long")
    j = related.withColumn("slug", X.clean_type(F.col("rel_type")))
    j = j.join(f, j.slug == f.f_type, "left").drop("f_type").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long"))).withColumn("max_freq", top)
    # The source's context comes last: that join leaves the rows together by source, as ranking needs them.
    j = with_context(j, context, "target", "target_uri")
    j = with_context(j, (source_context if source_context is not None else context).withColumn("title", F.lit(None).cast("string")), "source", "source_uri")
    for side in ("source", "target"):
        j = j.withColumn(f"{side}_specific", X.specific_media(F.col(f"{side}_media"), config))
    j = j.withColumn("tier", X.tier(F.col("slug"))).withColumns(
        {
            "base": X.base_score(F.col("tier")),
            "rarity_bonus": X.rarity_bonus(F.col("freq"), F.col("max_freq")),
            "author_bonus": X.author_bonus(F.col("source_agents"), F.col("target_agents")),
            "medium_bonus": X.medium_bonus(F.col("source_specific"), F.col("target_specific")),
        }
    )
    total = X.clamp(F.col("base") + F.col("rarity_bonus") + F.col("author_bonus") + F.col("medium_bonus"))
    return j.withColumns({"score": total, "label": X.label(F.col("rel_type")), "title": F.col("target_title"), "media": F.transform("target_specific", lambda m: X.basename(m)), "different_author": X.different_author(F.col("source_agents"), F.col("target_agents"))})


def breakdown() -> Column:
    """The parts of a score as shown: only here is the rarity rounded."""
    return F.struct("tier", "base", F.round("rarity_bonus", 1).alias("rarityBonus"), F.col("author_bonus").alias("authorBonus"), F.col("medium_bonus").alias("mediumBonus"))


def ranked(scored: DataFrame) -> DataFrame:
    """Adds `rank` per source: by score, then by target."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("source_uri").orderBy(F.desc("score"), "target_uri")))


def top(scored: DataFrame, n: int = 10) -> DataFrame:
    return ranked(scored).filter(F.col("rank") <= n)


def grouped_rows(rank: DataFrame) -> DataFrame:
    """Adds to each ranked row its group's best score, tier, size, whether it shows expanded, and the group's rank.

    The same as `grouped` with a row per result, for rankings without a cap: no group is gathered into one row.
    """
    own = Window.partitionBy("source_uri", "label")
    all_ = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = rank.withColumns({"top_score": F.max("score").over(all_), "group_tier": F.min_by("tier", "rank").over(all_), "n_results": F.count(F.lit(1)).over(all_)})
    order = Window.partitionBy("source_uri").orderBy(F.desc("top_score"), "label")
    return r.withColumns({"expanded": F.col("group_tier") <= 2, "group_rank": F.dense_rank().over(order)})


def grouped(rank: DataFrame) -> DataFrame:
    """Per source and label: the best score, the tier of the best row, whether it shows expanded, and the rows in rank order.

    `group_rank` orders the groups of a source by their best score, then by label. A group holds all rows of its source and
    label, so `rank` is best capped before, by `top` or `validation.shown`.
    """
    row = F.struct("rank", "target_uri", "title", "rel_type", "score", "media", "different_author")
    g = rank.groupBy("source_uri", "label").agg(F.max("score").alias("top_score"), F.min_by("tier", "rank").alias("tier"), F.count(F.lit(1)).alias("n_results"), F.array_sort(F.collect_list(row)).alias("results"))
    order = Window.partitionBy("source_uri").orderBy(F.desc("top_score"), "label")
    return g.withColumns({"expanded": F.col("tier") <= 2, "group_rank": F.row_number().over(order)})


def summary(scored: DataFrame) -> DataFrame:
    """Per source: how many neighbours, how many of interest (50 or more), how many not (below 20)."""
    return scored.groupBy("source_uri").agg(F.count(F.lit(1)).alias("n_related"), F.count_if(F.col("score") >= 50).alias("n_interesting"), F.count_if(F.col("score") < 20).alias("n_low"))


def display(scored: DataFrame) -> DataFrame:
    """What a list shows: a title in any case, and the media as one text."""
    return scored.select("source_uri", "target_uri", F.coalesce("title", F.lit("Unknown")).alias("title"), F.array_join("media", ", ").alias("media"), "label", "different_author")
