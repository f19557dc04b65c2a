"""Sinks: tables, batches posted to an index, cache logs and text reports; and the decoding of a graph server's answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A Parquet table, partitioned by a column if one is named."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str = "hub_uri", buckets: int = 256) -> None:
    """A table bucketed and sorted by its key, so that joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def post_batches(documents: DataFrame, post: Callable[[str], int], size: int = 50, commit: Callable[[], int] | None = None) -> None:
    """Posts JSON arrays of up to `size` documents; a status of 300 or more fails the task. `post` returns the status.

    `commit` is called once, on the driver, after all batches of all tasks were posted, and never if one failed.
    """

    def send(rows: Iterator) -> None:
        rows = iter(rows)
        while batch := list(islice(rows, size)):
            status = post(json.dumps([{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in batch], ensure_ascii=False))
            if status >= 300:
                raise RuntimeError(f"the index answered {status}")

    documents.foreachPartition(send)
    if commit and (status := commit()) >= 300:
        raise RuntimeError(f"the index answered {status} to the commit")


def append_log(entries: DataFrame, path: str) -> None:
    """Appends cache entries; reading keeps the last one per URI."""
    entries.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    """The entries of a log that have not expired; expired files can be pruned by their statistics."""
    return spark.read.parquet(path).filter(F.col("checked_at") > as_of - F.make_interval(secs=F.lit(ttl_seconds)))


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], ttl_seconds: int) -> DataFrame:
    """A materialised table, built again when it is missing or older than its time to live; such as the type frequencies."""
    try:
        newest = spark.read.format("binaryFile").load(path).agg(F.max("modificationTime").cast("double").alias("at")).first()["at"]
    except AnalysisException:  # no such folder
        newest = None
    if newest is None or time.time() - newest >= ttl_seconds:
        write_table(build(), path)
    return spark.read.parquet(path)


def decode_rows(answer: Column, columns: list[str]) -> Column:
    """Rows of a graph server's JSON answer `{results: [{columns, data: [{row: [...]}]}]}` as structs of texts.

    An answer that is empty, is no JSON or names errors fails the query with the first error's message.
    """
    parsed = F.from_json(answer, "results array<struct<columns array<string>, data array<struct<row array<string>>>>>, errors array<struct<code string, message string>>")
    first = F.get(parsed["errors"], F.lit(0))
    wrong = F.when(F.coalesce(answer, F.lit("")) == "", F.lit("empty answer")).when(parsed["results"].isNull() & first.isNull(), F.lit("no answer of a graph server")).when(first.isNotNull(), F.concat_ws(": ", first["code"], first["message"]))
    data = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<struct<row array<string>>>")).otherwise(F.coalesce(F.get(parsed["results"], F.lit(0))["data"], F.array()))
    names = F.get(parsed["results"], F.lit(0))["columns"]
    # Columns are told by name, whatever order the server gives them in.
    return F.transform(data, lambda x: F.struct(*[F.get(x["row"], F.array_position(names, c).cast("int") - 1).alias(c) for c in columns]))


def report(ranked: DataFrame, n: int = 10) -> DataFrame:
    """A text line per result of the first `n` of each source."""
    line = F.format_string("%2d. %-40s %-24s %6.1f", F.col("rank"), F.substring(F.coalesce("title", F.lit("Unknown")), 1, 40), F.substring("label", 1, 24), F.col("score"))
    return ranked.filter(F.col("rank") <= n).select("source_uri", "rank", line.alias("line"))
