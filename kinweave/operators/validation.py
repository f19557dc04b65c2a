"""Checked URIs: latest entries within their time to live, what still needs a check, and which results may be shown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.config import Config
from kinweave.functions import exprs as X
from kinweave.session import broadcast_if_small, python_path


def latest(log: DataFrame) -> DataFrame:
    """The last entry per URI of `log(uri, valid, checked_at)`: the last write wins, and on a tie the valid one."""
    e = log.filter(F.col("uri").isNotNull()).groupBy("uri").agg(F.max(F.struct("checked_at", "valid")).alias("e"))
    return e.select("uri", "e.valid", "e.checked_at")


def live(log: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """The latest entries that have not expired at `as_of`."""
    return latest(log).filter(X.fresh(F.col("checked_at"), as_of, ttl_seconds))


def checkable(uris: DataFrame) -> DataFrame:
    """Distinct URIs that are neither null nor empty."""
    return uris.select("uri").filter("uri <> ''").distinct()


def need_check(uris: DataFrame, log: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Distinct URIs without a live entry."""
    return checkable(uris).join(live(log, as_of, ttl_seconds).select("uri"), "uri", "left_anti")


def valid_uris(log: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    return live(log, as_of, ttl_seconds).filter("valid").select("uri")


def skip_known_empty(hubs: DataFrame, negative: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Hubs without a live entry in `negative(uri, checked_at)`."""
    known = negative.groupBy("uri").agg(F.max("checked_at").alias("checked_at")).filter(X.fresh(F.col("checked_at"), as_of, ttl_seconds))
    return hubs.join(known.select(F.col("uri").alias("hub_uri")), "hub_uri", "left_anti")


def found_empty(parsed: DataFrame, as_of: Column) -> DataFrame:
    """What goes into the negative log: hubs whose RDF was read and holds no relation."""
    return parsed.filter(F.col("relations").isNotNull() & (F.size("relations") == 0)).select(F.col("uri"), as_of.alias("checked_at"))


def shown(ranked: DataFrame, valid: DataFrame, config: Config = Config()) -> DataFrame:
    """The results that may be shown, with their `shown_rank`.

    With validation on, only the best max(10, 3 N) results are looked up, and the first N valid ones are kept; valid results
    further down are lost. With it off everything is shown.
    """
    if not config.validate_uris:
        return ranked.withColumn("shown_rank", F.col("rank"))
    return kept(looked_up(ranked, config).join(broadcast_if_small(valid.select(F.col("uri").alias("target_uri"))), "target_uri", "left_semi"), config)


def looked_up(ranked: DataFrame, config: Config = Config()) -> DataFrame:
    """The results whose validity is looked up."""
    return ranked.filter((F.col("rank") <= max(10, 3 * config.max_display)) & (F.col("target_uri") != ""))


def kept(ok: DataFrame, config: Config = Config(), key: str = "source_uri") -> DataFrame:
    """The first valid results per `key`, with their `shown_rank`."""
    w = Window.partitionBy(key).orderBy("rank")
    return ok.withColumn("shown_rank", F.row_number().over(w)).filter(F.col("shown_rank") <= config.max_display)


def valid_primary(records: DataFrame, valid: DataFrame) -> DataFrame:
    """Nulls the `hub_uri` of records whose hub is not valid; their results are kept."""
    v = valid.select(F.col("uri").alias("v_uri"))
    return records.join(v, records.hub_uri == v.v_uri, "left").withColumn("hub_uri", F.when(F.col("v_uri").isNotNull(), F.col("hub_uri"))).drop("v_uri")


def check_live(uris: DataFrame, check: Callable[[str], bool], partitions: int = 10) -> DataFrame:
    """`uri, valid` by a checker of your own (such as a HEAD request), at most `partitions` at a time."""
    python_path(uris.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"uri": pdf["uri"], "valid": [bool(check(u)) for u in pdf["uri"]]})

    return checkable(uris).repartition(partitions, "uri").mapInPandas(run, "uri string, valid boolean")
