"""Pairs of records that share a key, with hot keys spread over tasks and no pair left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import checkpoint, spread

#: A key with more pairs than this is met in parts, each about so large.
MAX_PAIRS = 20_000


def meet(left: DataFrame, right: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Every `l, r` of `left(l, key, ...)` and `right(r, key, ...)` with a common key, once per key, with their other columns.

    A key with more than `max_pairs` pairs is cut on both sides into parts of about the root of `max_pairs` records, and
    every left part meets every right part. Null keys meet nothing; an empty side gives no pairs.
    """
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("nl")).join(spread(right.groupBy("key").agg(F.count(F.lit(1)).alias("nr"))), "key").filter(F.col("nl") * F.col("nr") > max_pairs)
    side = max(1, int(max_pairs**0.5))
    hot = checkpoint(sizes.select("key", F.ceil(F.col("nl") / side).alias("parts_l"), F.ceil(F.col("nr") / side).alias("parts_r")))

    def parts(k: DataFrame, own: str, other: str) -> DataFrame:
        """Each record in its own part, once for every part of the other side."""
        mine = F.pmod(F.xxhash64(own), F.col(f"parts_{own}")).alias(f"part_{own}")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{other}") - 1)).alias(f"part_{other}")
        return k.join(spread(hot), "key").select(*k.columns, mine, each)

    plain = left.join(hot, "key", "left_anti").join(spread(right), "key").drop("key")
    cut = parts(left, "l", "r").join(spread(parts(right, "r", "l")), ["key", "part_l", "part_r"])
    return plain.unionByName(cut.drop("key", "part_l", "part_r"))
