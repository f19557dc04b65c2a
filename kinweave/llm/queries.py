"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.uris import bare_slug, strip_blanks
from kinweave.llm import canonical, consistent, leakage, linkage, packing, splitting, termfreq, tokens, variants
from kinweave.session import broadcast_if_small, read


def _related_terms(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.term_frequencies(read(spark, d, "related").select(bare_slug(F.col("relType")).alias("value"), "sourceUri"), "value", "sourceUri")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Relation types that are too rare or too common to tell hubs apart."""
    return _related_terms(spark, d).filter("mark is not null").select(F.col("term").alias("value"), "mark")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and source hubs of every relation type."""
    return _related_terms(spark, d).withColumnRenamed("term", "value")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "rdf_relation").select("row_id", "relType").filter(strip_blanks(F.col("relType")) != "")
    ref = read(spark, d, "reltype_ref")
    uses = rows.groupBy(F.col("relType").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    typed = rows.join(broadcast_if_small(ref.select(F.col("slug").alias("relType"))), "relType", "left_anti")
    return canonical.map_values(typed, "relType", canonical.references(ref, "slug", "label", uses), "slug")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The slug meant by every free-entered relation type, or `[unmatched]`."""
    return _mapped(spark, d).select("row_id", "slug").distinct()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How often each value that means no entry of the list was entered."""
    return _mapped(spark, d).filter(F.col("slug") == canonical.UNMATCHED).groupBy("relType").agg(F.count(F.lit(1)).alias("n_rows"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "biblio").select("id", "title", "author")
    return own.unionByName(read(spark, d, "partner_record").select(F.col("ext_id").alias("id"), "title", "author"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every title and author that is not stored in the consistent form."""
    return consistent.inconsistent(_texts(spark, d), "id", ["title", "author"]).select("id", "field").distinct()


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """All titles and authors in their consistent form."""
    return consistent.with_consistent(_texts(spark, d), ["title", "author"]).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of headings of one person or organisation."""
    pairs = variants.variant_pairs(variants.variant_classes(read(spark, d, "agent_heading"), "heading_id", "author", "dates"))
    return pairs.select(F.col("a").alias("heading_a"), F.col("b").alias("heading_b"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each heading with the smallest heading of its person or organisation, and the size of that group."""
    c = variants.variant_classes(read(spark, d, "agent_heading"), "heading_id", "author", "dates").distinct()
    g = c.groupBy("class").agg(F.min("key").alias("first_heading"), F.count(F.lit(1)).alias("n_headings"))
    return c.join(g, "class").select(F.col("key").alias("heading_id"), "first_heading", "n_headings")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "biblio").select(F.col("id").alias("key"), "title", "author", F.col("lccn").alias("ident"), F.get("publishDate", F.lit(0)).alias("year"))
    other = read(spark, d, "partner_record").select(F.col("ext_id").alias("key"), "title", "author", F.col("lccn").alias("ident"), F.col("publish_year").alias("year"))
    return linkage.link(own, other)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every biblio record with each partner record of the same publication."""
    return _linked(spark, d).select("id", "ext_id")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The matches with their confidence."""
    return _linked(spark, d).withColumn("confidence", F.round("confidence", 6))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item and document that share 12 consecutive words, of which one may be changed."""
    found = leakage.leaks(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_item"), "item_id", "text", max_edits=1)
    return found.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "edits")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Those whose passages are equal word for word, which that listing never misses."""
    return p9_near(spark, d).filter("edits = 0").select("item_id", "doc_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items, and in how many documents each is."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its container of 1,024 tokens."""
    c = packing.containers(read(spark, d, "documents"), "doc_id", "text")
    return c.withColumnRenamed("doc", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, at least needed, and how full they are."""
    c = packing.containers(read(spark, d, "documents"), "doc_id", "text")
    t = c.groupBy("container").agg(F.sum("tokens").alias("used"))
    least = F.ceil(F.sum("used") / packing.CAPACITY)
    return t.agg(F.count(F.lit(1)).alias("n_containers"), least.alias("least_containers"), F.max("used").alias("most_used"), F.round(F.sum("used") / (F.count(F.lit(1)) * packing.CAPACITY), 6).alias("fill"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that must be cut, in tokens that need no vocabulary."""
    pieces = splitting.split(read(spark, d, "documents"), "doc_id", "text", vocabulary=tokens.PLAIN, with_text=False)
    return pieces.filter("piece = 1").select(F.col("doc").alias("doc_id")).distinct()  # a second piece exists


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all documents, in tokens of a public tokenizer."""
    return splitting.split(read(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p3_found, p3_unmatched, p4_found, p4_forms, p2_found, p2_classes, p5_found, p5_confidence, p9_found, p9_near, p9_items, p8_containers, p8_fill, p10_found, p10_pieces)}

_SLUG = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace("relType", '^[\s\xa0]+|[\s\xa0]+$', '', 'g')),
  '/+$', ''), '^[a-z][a-z0-9+.-]*://\S*[/#]', ''), '^ns[0-9]+__', ''), '(_inbound)+$', '')), '')"""
_TERMS = f"""WITH r AS (SELECT {_SLUG} AS value, "sourceUri" AS s FROM related), n AS (SELECT count(DISTINCT s) AS n FROM r),
 t AS (SELECT value, count(*) AS occurrences, count(DISTINCT s) AS records FROM r WHERE value IS NOT NULL GROUP BY value),
 m AS (SELECT t.*, CASE WHEN records <= 1 OR records * 1000 <= n THEN 'rare' WHEN records > 0.25 * n THEN 'common' END AS mark FROM t, n)"""
_W = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_SHARED = f"""WITH i AS (SELECT item_id, {_W.format(c='text')} AS w FROM eval_item), d AS (SELECT doc_id, {_W.format(c='text')} AS w FROM documents),
 iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
 dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
 shared AS (SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (g))"""
SQL = {
    "p10_found": r"""SELECT DISTINCT doc_id FROM documents
        WHERE len(regexp_extract_all(regexp_replace(text, '[\p{Hiragana}\p{Katakana}\p{Han}]', ' x ', 'g'), '[\p{L}\p{N}_]+|[^\s]')) > 512""",
    "p9_found": f"{_SHARED} SELECT item_id, doc_id FROM shared",
    "p9_items": f"{_SHARED} SELECT item_id, count(*) AS n_documents FROM shared GROUP BY ALL",
    "p1_found": f"{_TERMS} SELECT value, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": f"{_TERMS} SELECT value, occurrences, records, mark FROM m",
}
