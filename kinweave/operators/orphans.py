"""References to records that do not exist.

References are normalised once and pre-aggregated per key and period. Key-periods of the few heaviest keys are checked
against a broadcast slice of the target table, those of all other keys by a shuffle join, and both sets of orphans are
united. Row listings join the references back to the key-periods that hold an orphan, heavy ones by broadcast again, so the
references of a heavy key are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.uris import hub_name, is_hub_uri
from kinweave.session import checkpoint

#: A key with more than this share of the references is heavy; so there are fewer than its inverse.
HEAVY_SHARE = 1 / 64


def references(df: DataFrame, src_table: str, row_id: str, uri: str, at: str) -> DataFrame:
    """One row per reference: `src_table, row_id, key, at, period` (the first of the month); references that name no hub path are left out."""
    c = F.col(uri)
    return df.filter(is_hub_uri(c)).select(
        F.lit(src_table).alias("src_table"), F.col(row_id).cast("long").alias("row_id"), hub_name(c).alias("key"), F.col(at).alias("at"), F.trunc(at, "month").alias("period")
    )


def lifetimes(hub: DataFrame, uri: str = "hub_uri", created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """One row per target key: `key, born, died`. Repeated rows are merged: earliest birth, and a death only if no row is alive.

    A null `created` means the target always existed.
    """
    epoch = F.lit("0001-01-01 00:00:00").cast("timestamp")
    return (
        hub.filter(is_hub_uri(F.col(uri)))
        .select(hub_name(F.col(uri)).alias("key"), F.coalesce(F.col(created), epoch).alias("born"), F.col(deleted).alias("died"))
        .groupBy("key")
        .agg(F.min("born").alias("born"), F.when(F.count("died") == F.count(F.lit(1)), F.max("died")).alias("died"))
    )


def _reason(at: Column, found: Column, born: Column, died: Column) -> Column:
    return F.when(found.isNull(), "missing").when(born > at, "late").when(died <= at, "deleted")


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM").alias(c)


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key", "src_table", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def heavy_keys(counts: DataFrame, share: float = HEAVY_SHARE) -> list[str]:
    """The keys with more than `share` of all references, from their pre-aggregated counts; fewer than 1 / `share`."""
    total = counts.agg(F.sum("n").cast("double")).scalar()
    each = counts.groupBy("key").agg(F.sum("n").alias("n"))
    return sorted(r["key"] for r in each.filter(F.col("n") > share * total).select("key").collect())


def _split(df: DataFrame, hub: DataFrame, heavy: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    if not heavy:
        return [(df, hub)]
    hot = F.col("key").isin(heavy)
    return [(df.filter(~hot), hub.filter(~hot)), (df.filter(hot), F.broadcast(hub.filter(hot)))]  # a row per heavy key


def orphan_rows(refs: DataFrame, hub: DataFrame, heavy: list[str] | None = None) -> DataFrame:
    """Every orphan reference: `src_table, row_id, period, reason`, distinct.

    `refs` as from `references`, `hub` as from `lifetimes`. A reference without a time is an orphan only when its key is
    missing, with a null period. Null keys never get here; repeated rows collapse.
    """
    refs = checkpoint(refs)
    counts = checkpoint(_counted(refs))
    heavy = heavy_keys(counts) if heavy is None else heavy
    parts = []
    for (c, h), (r, _) in zip(_split(counts, hub, heavy), _split(refs, hub, heavy)):
        # Key-periods whose references all fall inside the target's life hold no orphan.
        whole = F.col("found") & (F.col("born") <= F.col("first_at")) & (F.col("died").isNull() | (F.col("died") > F.col("last_at")))
        timeless = F.col("found") & F.col("first_at").isNull()
        suspects = c.join(h.withColumn("found", F.lit(True)), "key", "left").filter(~F.coalesce(whole | timeless, F.lit(False)))
        # Renamed, so that the join condition stays an equi-join for null periods too.
        s = suspects.select(*[F.col(k).alias(f"s_{k}") for k in ("key", "src_table", "period")], "found", "born", "died")
        s = F.broadcast(s) if parts else s  # of heavy keys: a row per key, table and period
        met = r.join(s, (r.key == s.s_key) & (r.src_table == s.s_src_table) & r.period.eqNullSafe(s.s_period))
        parts.append(met.select("src_table", "row_id", _month("period"), _reason(F.col("at"), F.col("found"), F.col("born"), F.col("died")).alias("reason")).filter("reason is not null"))
    return reduce(DataFrame.unionByName, parts).distinct()


def orphan_keys(refs: DataFrame, hub: DataFrame, heavy: list[str] | None = None) -> DataFrame:
    """Per table and period, how many references name a key that is `missing`: `src_table, period, orphan_keys, orphan_refs`.

    Only pre-aggregated rows are shuffled: heavy keys meet a broadcast slice of `hub`, the rest an anti-join.
    """
    counts = checkpoint(_counted(refs))
    heavy = heavy_keys(counts) if heavy is None else heavy
    parts = [c.join(h, "key", "left_anti") for c, h in _split(counts, hub, heavy)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("src_table", _month("period")).agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").alias("orphan_refs"))


def orphan_report(rows: DataFrame) -> DataFrame:
    """Orphan references per table, period and reason."""
    return rows.groupBy("src_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
