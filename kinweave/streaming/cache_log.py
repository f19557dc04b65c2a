"""Cache logs as streams: repeats within the time to live dropped, and the last state per URI kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "uri string, valid boolean, checked_at timestamp"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries as files arrive."""
    return spark.readStream.schema(LOG).parquet(path)


def first_within(log: DataFrame, ttl: str = "1 day") -> DataFrame:
    """One entry per URI within the time to live: what has to be checked again, and no more. State expires with the watermark."""
    return log.withWatermark("checked_at", ttl).dropDuplicatesWithinWatermark(["uri"])


def counts(log: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Checks and valid ones per window; entries later than `late` are left out."""
    w = log.withWatermark("checked_at", late).groupBy(F.window("checked_at", window).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("valid").alias("n_valid")).select(F.col("w.start").alias("start"), "n_checks", "n_valid")


def append(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a log table, exactly once, and ends when what is there has been read."""
    return log.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
