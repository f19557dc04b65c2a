"""How often every distinct term occurs, in how many records, and which terms are too rare or too common to be useful.

Vertical layout: record identifiers are dense integers, and each term has a compressed bitmap of identifiers next to a
parallel occurrence counter. A bitmap is kept as its 64-bit words that are not zero, one row each, so a term of a single
record costs one word and a term of all records one bit a record. Parts merge by union of their words and sum of their
counters, within a task, between tasks and between postings; the document frequency of a term is its bitmap's cardinality.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Mean number of records that are numbered together.
RECORDS_PER_BUCKET = 16_384


def record_count(df: DataFrame, record: str) -> int:
    """Distinct non-null records; map-side combined, so a record that holds a third of the rows costs nothing more."""
    return df.select(record).filter(F.col(record).isNotNull()).distinct().count()


def postings(df: DataFrame, term: str, record: str, n_records: int) -> DataFrame:
    """`term, bucket, at, bits, occurrences` over all rows of `df` with a term: the words of the terms' bitmaps.

    Rows are first combined per (term, record), which takes the weight off hot records and hot terms. Records are then
    numbered within hash buckets, so numbering needs no global sort and the bitmaps are built where the numbers are.
    A row with a term but no record counts as an occurrence only: its word is null.
    """
    pairs = df.select(F.col(term).alias("term"), F.col(record).alias("record")).filter("term is not null").groupBy("term", "record").agg(F.count(F.lit(1)).alias("n"))
    buckets = max(1, ceil(n_records / RECORDS_PER_BUCKET))
    numbered = pairs.withColumn("bucket", F.pmod(F.xxhash64("record"), F.lit(buckets))).withColumn(
        "number", F.dense_rank().over(Window.partitionBy("bucket").orderBy("record")) - 1
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)
    known = F.col("record").isNotNull()
    words = numbered.select("term", "bucket", F.when(known, F.floor(F.col("number") / 64)).alias("at"), F.when(known, bit).alias("bits"), F.col("n").alias("occurrences"))
    # The window's partitioning by bucket serves this union as well: no further shuffle.
    return merge(words)


def merge(*parts: DataFrame) -> DataFrame:
    """Union of postings over the same record numbering: of the bitmaps, and the sum of the counters."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("bucket", "term", "at").agg(F.bit_or("bits").alias("bits"), F.sum("occurrences").alias("occurrences"))


def frequencies(post: DataFrame) -> DataFrame:
    """`term, occurrences, records`: one row per distinct term."""
    return post.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long")).alias("records"))


def mark(freq: DataFrame, n_records: int, rare_per: int = 1000, common_share: float = 0.25) -> DataFrame:
    """Adds `mark`: `rare` (in at most one record, or in at most 1 in `rare_per` of all), `common` (in more than
    `common_share` of all), else null. In a tiny collection where both hold, `rare` wins.
    """
    rare = (F.col("records") <= 1) | (F.col("records") * rare_per <= n_records)
    common = F.col("records") > common_share * n_records
    return freq.withColumn("mark", F.when(rare, "rare").when(common, "common"))


def term_frequencies(df: DataFrame, term: str, record: str) -> DataFrame:
    """`term, occurrences, records, mark` of every distinct non-null term of `df`.

    All records count, those without any term included. An empty table gives an empty result.
    """
    n = record_count(df, record)
    return mark(frequencies(postings(df, term, record, n)), n)
