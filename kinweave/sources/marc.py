"""MARC records: files of XML, XML in a column, and the index documents made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.model import MARC
from kinweave.operators.resolve import subfields


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """`marc` of every record of MARCXML files; files are split by record, never read whole."""
    schema = spark.createDataFrame([], MARC).schema
    rows = spark.read.format("xml").option("rowTag", "record").schema(schema).load(path)
    return rows.select(F.struct(*schema.fieldNames()).alias("marc"))


def from_column(xml: Column) -> Column:
    """A stored record as a struct; malformed input gives a struct of nulls."""
    return F.from_xml(xml, MARC, {"rowTag": "record"})


def control(marc: Column, tag: str) -> Column:
    return F.get(F.filter(marc["controlfield"], lambda c: c["_tag"] == tag), F.lit(0))["_VALUE"]


def _raw(marc: Column, tag: str, code: str) -> Column:
    return F.get(subfields(marc, tag, code), F.lit(0))


def index_document(records: DataFrame, prefix: str) -> DataFrame:
    """One index document per record `marc` with an identifier; fields without a value are null.

    `fullrecord` is the stored record: the column `xml` where there is one, else the record written as XML again.
    The date is the first four digits of 264 $c, or of 260 $c only where there is no 264 $c.
    """
    m = F.col("marc")
    empty = F.lit("")
    number = F.trim(control(m, "001"))
    head = F.rtrim(F.coalesce(_raw(m, "245", "a"), empty), F.lit(" /:,"))
    rest = F.rtrim(F.coalesce(_raw(m, "245", "b"), empty), F.lit(" /:,"))
    title = F.when(rest != "", F.concat(head, F.lit(": "), rest)).otherwise(head)
    author = F.rtrim(F.coalesce(F.nullif(_raw(m, "100", "a"), empty), _raw(m, "110", "a")), F.lit(" ,"))
    fixed = control(m, "008")
    language = F.trim(F.when(F.length(fixed) >= 38, F.substring(fixed, 36, 3)))
    date = F.regexp_extract(F.coalesce(F.nullif(_raw(m, "264", "c"), empty), _raw(m, "260", "c")), r"(\d{4})", 1)
    one = lambda c: F.when(c != "", F.array(c))
    xml = F.col("xml") if "xml" in records.columns else F.to_xml(m, {"rowTag": "record"})
    docs = records.select(number.alias("number"), xml.alias("fullrecord"), F.when(title != "", title).otherwise(F.lit("[Untitled]")).alias("title"), F.nullif(author, empty).alias("author"), one(language).alias("language"), one(date).alias("publishDate"))
    docs = docs.filter("number <> ''")
    return docs.select(
        F.concat(F.lit(f"{prefix}-"), "number").alias("id"), "title", F.col("title").alias("title_short"), F.col("title").alias("title_full"), F.lower("title").alias("title_sort"), F.col("title").alias("title_auth"),
        "author", F.col("author").alias("author_sort"), F.array(F.lit("Book")).alias("format"), F.lit("marc").alias("record_format"), "language", "publishDate", "fullrecord",
    )


def load_totals(records: DataFrame) -> DataFrame:
    """How many records are loaded, and how many are skipped for want of an identifier."""
    ok = F.coalesce(F.trim(control(F.col("marc"), "001")), F.lit("")) != ""
    return records.agg(F.count_if(ok).alias("n_loaded"), F.count_if(~ok).alias("n_skipped"))


def not_loaded(documents: DataFrame, index: DataFrame) -> DataFrame:
    """The documents that the index does not hold yet."""
    return documents.join(index.select("id"), "id", "left_anti")


def seed(documents: DataFrame, index: DataFrame) -> DataFrame:
    """The documents to load into an index that is empty, else none."""
    return documents.join(index.select("id").limit(1), F.lit(True), "left_anti")


def count_by_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return index.filter(F.col("id").startswith(f"{prefix}-")).agg(F.count(F.lit(1)).alias("n_records"))
