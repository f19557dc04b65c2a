"""A bibliographic graph projected from the star-schema tables, for tests and benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.model import Graph, with_typed
from kinweave.session import checkpoint, read

# Relation types in the order in which the projection numbers them.
SLUGS = """translationof relatedwork partof inseries containerof translatedas relatedto sequel basedon adaptedas continuedby revisionof abridgedas supplementto
 remakeof librettofor adaptedasmotionpicture dramatizationof operaadaptationof musicalsettingof derivative parodyof inspirationfor graphicnovelizationof""".split()


def hub_uri(key, config: Config):
    return F.concat(F.lit(f"http://{config.host}/resources/hubs/"), key.cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive lines of an order: one row per pair, with the columns that the relation depends on."""
    li = read(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    b = li.select(F.col("l_orderkey").alias("b_order"), (F.col("l_linenumber") - 1).alias("b_line"), F.col("l_partkey").alias("b_part"))
    # A merge join also where a broadcast would do: it spreads what a single small file would leave in one task.
    return a.join(b.hint("merge"), (F.col("l_orderkey") == F.col("b_order")) & (F.col("l_linenumber") == F.col("b_line"))).withColumn(
        "relation_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "b_part")
    )


def graph(spark: SparkSession, d: str, config: Config = Config(), keep: bool = False) -> Graph:
    """The projection; with `keep` its relations are written once, for plans that read them more than once."""
    part = read(spark, d, "part")
    uri = hub_uri(F.col("p_partkey"), config)
    hub = part.select(uri.alias("hub_uri"))
    titles = F.when(F.col("p_size") % 10 == 0, F.array("p_name", "p_brand")).otherwise(F.array("p_name"))
    title = part.select(uri.alias("hub_uri"), F.concat(F.lit("title:"), F.col("p_partkey")).alias("title_node"), titles.alias("main_titles"))
    bf = config.ontology
    media = F.create_map(*[F.lit(x) for k, v in (("MEDIUM", "MovingImage"), ("STANDARD", "Text"), ("LARGE", "NotatedMusic"), ("PROMO", "Audio")) for x in (k, bf + v)])
    kind = part.select(uri.alias("hub_uri"), F.explode(F.array_compact(F.array(F.lit(f"{bf}Hub"), F.try_element_at(media, F.col("p_type"))))).alias("type_uri"))
    rwo = f"http://{config.host}/rwo/agents/"
    second = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(f"{rwo}Brand#"), 1 + F.col("p_size") % 25))
    agents = F.array_distinct(F.array_compact(F.array(F.concat(F.lit(rwo), "p_brand"), second)))
    agent = part.filter("p_size % 7 <> 0").select(uri.alias("hub_uri"), F.explode(agents).alias("agent_uri"))
    number = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    spaced = F.when(F.col("p_size") % 2 == 0, F.concat(F.substring(number, 1, 4), F.lit(" "), F.substring(number, 5, 6))).otherwise(number)
    identifier = part.select(uri.alias("hub_uri"), spaced.alias("id_value"))

    e = edges(spark, d)
    target = F.when(F.col("l_orderkey") % 41 == 0, F.concat(F.lit(f"http://{config.host}/resources/works/"), "b_part")).otherwise(hub_uri(F.col("b_part"), config))
    vocabulary, entities = config.relationship_prefixes
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.floor(F.col("l_quantity") * F.col("l_quantity") / 108) + 1).cast("int"))
    typed = F.concat(F.when(F.col("l_linestatus") == "O", vocabulary).otherwise(entities), slug)
    first = F.when((F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 20 == 3), F.concat(F.lit("bnode://"), "relation_id")).otherwise(typed)
    second = F.when(F.col("l_quantity") % 9 == 0, F.lit(f"{vocabulary}relatedwork"))
    own = F.when(F.col("l_suppkey") % 17 != 0, F.array_compact(F.array(first, second)))
    # The numbers in the identifier determine it and both ends, so grouping by them is a distinct. The edges lie together by the
    # first two, so it needs no shuffle, and what is written is the numbers, not the addresses made of them.
    numbers = ["l_orderkey", "l_linenumber", "l_partkey", "b_part"]
    both = e.select(*numbers, own.alias("t")).groupBy(*numbers).agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("types"))
    both = checkpoint(both) if keep else both
    both = both.select(F.concat_ws("-", *numbers).alias("relation_id"), hub_uri(F.col("l_partkey"), config).alias("source_uri"), target.alias("target_uri"), "types")
    g = Graph(hub, title, agent, kind, identifier, both.select("relation_id", "source_uri", "target_uri"), both.select("relation_id", F.explode("types").alias("type_uri")))
    return with_typed(g, both) if keep else g
