"""Queries over stored records and references: problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import nested, orphans
from kinweave.session import read


def _flat(spark: SparkSession, d: str, tag: str) -> DataFrame:
    return nested.table(nested.flatten(read(spark, d, "biblio")), tag)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every subfield of every data field of `biblio.fullrecord`, distinct."""
    return _flat(spark, d, "subfield").select("id", "field_seq", "tag", "sub_seq", "code").distinct()


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "record").select("pk", "id", "leader", "n_controls", "n_fields").distinct()


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "field").drop("id").withColumnRenamed("parent_pk", "record_pk").distinct()


def p6_subfields(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "subfield").select("pk", F.col("parent_pk").alias("field_pk"), "sub_seq", "code", "value").distinct()


def _references(spark: SparkSession, d: str) -> DataFrame:
    return (
        orphans.references(read(spark, d, "related"), "related", "rel_id", "targetUri", "loaded_at")
        .unionByName(orphans.references(read(spark, d, "rdf_relation"), "rdf_relation", "row_id", "targetUri", "fetched_at"))
        .unionByName(orphans.references(read(spark, d, "validation_log"), "validation_log", "check_id", "uri", "checked_at"))
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to a hub that did not exist at the time, with the reason."""
    return orphans.orphan_rows(_references(spark, d), orphans.lifetimes(read(spark, d, "hub")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphans.orphan_report(p7_found(spark, d))


def p7_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per table and month, the keys that no hub ever had, and the references to them."""
    return orphans.orphan_keys(_references(spark, d), orphans.lifetimes(read(spark, d, "hub")))


QUERIES = {f.__name__: f for f in (p6_found, p6_records, p6_fields, p6_subfields, p7_found, p7_report, p7_missing_keys)}

_KEY = """CASE WHEN regexp_extract({c}, '(?i)^[\\s\\xa0]*https?://[^/?#]+(/[^?#]*)', 1) LIKE '/resources/hubs/_%'
  THEN lower(regexp_extract({c}, '(?i)^[\\s\\xa0]*https?://([^/?#]+)', 1))
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract({c}, '(?i)^[\\s\\xa0]*https?://[^/?#]+(/[^?#]*)', 1), '[\\s\\xa0]+$', ''), '/+$', ''), '(?i)\\.(rdf|json|html)$', ''), '/+$', '') END"""

_REFS = f"""refs AS (
  SELECT *, strftime(seen, '%Y-%m') AS period FROM (
    SELECT 'related' AS src_table, rel_id AS row_id, {_KEY.format(c='"targetUri"')} AS key, loaded_at AT TIME ZONE 'UTC' AS seen FROM related
    UNION ALL SELECT 'rdf_relation', row_id, {_KEY.format(c='"targetUri"')}, fetched_at AT TIME ZONE 'UTC' AS seen FROM rdf_relation
    UNION ALL SELECT 'validation_log', check_id, {_KEY.format(c='uri')}, checked_at AT TIME ZONE 'UTC' AS seen FROM validation_log)
  WHERE key IS NOT NULL),
life AS (
  SELECT {_KEY.format(c='hub_uri')} AS key, min(created_at AT TIME ZONE 'UTC') AS born,
         CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at AT TIME ZONE 'UTC') END AS died FROM hub GROUP BY 1),
found AS (
  SELECT DISTINCT src_table, row_id, period, CASE WHEN life.key IS NULL THEN 'missing' WHEN born > seen THEN 'late' WHEN died <= seen THEN 'deleted' END AS reason
  FROM refs LEFT JOIN life ON refs.key = life.key
  WHERE life.key IS NULL OR born > seen OR died <= seen)"""

SQL = {
    "p7_found": f"WITH {_REFS} SELECT src_table, row_id, period, reason FROM found",
    "p7_report": f"WITH {_REFS} SELECT src_table, period, reason, count(*) AS n_orphans FROM found GROUP BY ALL",
    "p7_missing_keys": f"""WITH {_REFS} SELECT src_table, period, count(DISTINCT key) AS orphan_keys, count(*) AS orphan_refs
        FROM refs WHERE key NOT IN (SELECT key FROM life WHERE key IS NOT NULL) GROUP BY ALL""",
}
