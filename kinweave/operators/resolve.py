"""From records to hubs: MARC fields, titles, numbers and labels, in a cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.config import Config
from kinweave.functions import exprs as X
from kinweave.model import Graph

# MARC fields. `marc` is a struct as in `kinweave.model.MARC`.


def fields(marc: Column, tag: str) -> Column:
    return F.filter(marc["datafield"], lambda d: d["_tag"] == tag)


def subfields(marc: Column, tag: str, codes: str) -> Column:
    """All values of the given codes, in document order."""
    each = F.transform(fields(marc, tag), lambda d: F.filter(d["subfield"], lambda s: s["_code"].isin(list(codes))))
    return F.transform(F.flatten(each), lambda s: s["_VALUE"])


def first_value(marc: Column, tag: str, code: str) -> Column:
    """The first non-empty value, trimmed."""
    return F.get(F.filter(F.transform(subfields(marc, tag, code), lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))


def first_hub_uri(marc: Column, tag: str, config: Config) -> Column:
    """The first `$0` or `$1`, in document order, that is a hub's URI."""
    return F.get(F.filter(subfields(marc, tag, "01"), lambda v: X.is_hub(v, config)), F.lit(0))


# What `$i` says when the linked work is the record's own.
_SELF = ("has work manifested", "expression of", "has expression manifested")


def work_relations(marc: Column, config: Config) -> Column:
    """The record's 758 fields: `hubUri, authUri, label, relLabel, relUri, isSelfHub`, those with a hub or a relation label."""

    def one(d: Column) -> Column:
        def values(code: str) -> Column:
            return F.filter(F.transform(F.filter(d["subfield"], lambda s: s["_code"] == code), lambda s: F.trim(s["_VALUE"])), lambda v: v != "")

        def first(code: str) -> Column:
            return F.get(values(code), F.lit(0))

        rel = first("i")
        own = reduce(lambda a, b: a | b, [X.contains_ignoring_case(rel, p) for p in _SELF])
        return F.struct(
            F.get(F.filter(F.concat(values("0"), values("1")), lambda v: X.is_hub(v, config)), F.lit(0)).alias("hubUri"),
            first("0").alias("authUri"), X.trim_punctuation(first("a")).alias("label"), X.trim_punctuation(rel, " :").alias("relLabel"), first("4").alias("relUri"), F.coalesce(own, F.lit(False)).alias("isSelfHub"),
        )

    return F.filter(F.transform(fields(marc, "758"), one), lambda r: r["hubUri"].isNotNull() | r["relLabel"].isNotNull())


def self_hub(relations: Column) -> Column:
    return F.get(F.filter(relations, lambda r: r["isSelfHub"] & r["hubUri"].isNotNull()), F.lit(0))["hubUri"]


def marc_fields(records: DataFrame, config: Config = Config()) -> DataFrame:
    """`id, author, title, uniform_title, lccn, hub_uri, work_relations` of records `id, title_short, title, author, lccn, marc`.

    Text fields lose trailing ` /;:,.`; one that becomes empty stays empty rather than giving way to the next source.
    """
    m = F.col("marc")
    rel = work_relations(m, config)
    hub = F.coalesce(first_hub_uri(m, "130", config), first_hub_uri(m, "240", config), self_hub(rel))
    raw = {
        "author": F.col("author"), "title": F.coalesce("title_short", "title"), "uniform_title": F.coalesce(first_value(m, "130", "a"), first_value(m, "240", "a")),
        "lccn": F.coalesce("lccn", first_value(m, "010", "a")), "hub_uri": hub,
    }
    return records.select("id", *[X.trim_punctuation(c).alias(n) for n, c in raw.items()], rel.alias("work_relations"))


def resolvable(extracted: DataFrame) -> DataFrame:
    """Records with a title of some kind; the others have no related works."""
    return extracted.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("uniform_title", F.lit("")) != ""))


# Lookups in the graph


def by_lccn(records: DataFrame, graph: Graph) -> DataFrame:
    """`id, hub_uri`: the smallest hub with the record's LCCN, whatever blanks either holds."""
    ids = graph.identifier.select(F.replace("id_value", F.lit(" ")).alias("key"), "hub_uri").groupBy("key").agg(F.min("hub_uri").alias("hub_uri"))
    r = records.select("id", X.strip_spaces(F.col("lccn")).alias("key")).filter("key <> ''")
    return r.join(ids, "key").select("id", "hub_uri")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}#]+"), lambda t: t != "")


def title_search(queries: DataFrame, graph: Graph, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`id, title_node, hub_uri, relevance`: title nodes that hold every word of the query `id, title`, by BM25.

    A leading article does not count. Queries are searched once per distinct text, and joined on their rarest word alone: the
    other words are looked for in what that brings, so common words are never met with their whole list of titles.
    """
    asked = queries.select("id", X.strip_article(F.col("title")).alias("text")).filter("text <> ''")
    nodes = graph.title.select("hub_uri", "title_node", _tokens(F.array_join("main_titles", " ")).alias("held"))
    n, mean = nodes.agg(F.count(F.lit(1)).cast("double")).scalar(), nodes.agg(F.avg(F.size("held"))).scalar()
    # Only identifiers travel with a token; the words of a title are fetched for what the rarest word brings.
    post = nodes.select("hub_uri", "title_node", F.explode(F.array_distinct("held")).alias("token"))
    often = post.groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("df"))
    q = asked.select("text").distinct().select("text", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("token"), F.size(F.array_distinct(_tokens(F.col("text")))).alias("n_terms"))
    q = q.join(often, "token").groupBy("text", "n_terms").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("terms")).filter(F.size("terms") == F.col("n_terms"))
    met = q.select("text", "terms", F.col("terms")[0]["token"].alias("token")).join(post, "token").drop("token")
    met = met.join(nodes, ["hub_uri", "title_node"]).filter(F.size(F.array_except(F.transform("terms", lambda t: t["token"]), F.col("held"))) == 0).withColumns({"n": n, "mean": mean})

    def part(t: Column) -> Column:
        tf = F.size(F.filter("held", lambda x: x == t["token"])).cast("double")
        idf = F.log(1.0 + (F.col("n") - t["df"] + 0.5) / (t["df"] + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("held") / F.col("mean")))

    found = met.select("text", "title_node", "hub_uri", F.aggregate("terms", F.lit(0.0), lambda s, t: s + part(t)).alias("relevance"))
    return asked.join(found, "text").select("id", "title_node", "hub_uri", "relevance")


def by_title(queries: DataFrame, graph: Graph, degrees: DataFrame, config: Config = Config()) -> DataFrame:
    """`id, hub_uri, rels`: of the most relevant hubs of each query (as many as `title_candidates`), the best connected one.

    Each distinct title is answered once, however many records ask for it.
    """
    asked = queries.select("id", X.strip_article(F.col("title")).alias("text"))
    texts = asked.select(F.col("text").alias("id"), F.col("text").alias("title")).filter("title <> ''").distinct()
    hits = title_search(texts, graph).filter(F.col("relevance") > config.title_threshold)
    hubs = hits.groupBy("id", "hub_uri").agg(F.max("relevance").alias("relevance"))
    w = Window.partitionBy("id").orderBy(F.desc(F.round("relevance", 9)), "hub_uri")
    few = hubs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= config.title_candidates)
    n = degrees.select("hub_uri", (F.col("out_rels") + F.col("in_rels")).alias("rels"))
    best = few.join(n, "hub_uri").groupBy("id").agg(F.min(F.struct((-F.col("rels")).alias("r"), "hub_uri")).alias("b"))
    return asked.join(best.select(F.col("id").alias("text"), "b"), "text").select("id", "b.hub_uri", (-F.col("b.r")).alias("rels"))


def cascade(records: DataFrame, graph: Graph, degrees: DataFrame, suggest: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """`id, hub_uri, strategy`: the record's own hub URI, else its LCCN's, else its title's, else the suggested one.

    Each costlier lookup sees only the records that the cheaper ones left.
    """
    marc = records.filter("hub_uri <> ''").select("id", "hub_uri", F.lit("marc").alias("strategy"))
    rest = records.join(marc.select("id"), "id", "left_anti")
    number = by_lccn(rest, graph).withColumn("strategy", F.lit("lccn"))
    rest = rest.join(number.select("id"), "id", "left_anti")
    title = by_title(rest.select("id", F.coalesce(F.nullif("uniform_title", F.lit("")), "title").alias("title")).filter("title <> ''"), graph, degrees, config).select("id", "hub_uri", F.lit("title").alias("strategy"))
    found = marc.unionByName(number).unionByName(title)
    if suggest is not None:
        rest = rest.join(title.select("id"), "id", "left_anti")
        found = found.unionByName(rest.select("id").join(suggest.select("id", "hub_uri"), "id").withColumn("strategy", F.lit("suggest")))
    return records.select("id").join(found, "id", "left").select("id", "hub_uri", F.coalesce("strategy", F.lit("none")).alias("strategy"))


# Lookups by label. `labels(label, hub_uri)`; `hits(id, query_kind, position, uri, aLabel, identifiers)`.


def by_label(wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """`id, hub_uri`: the hub whose access point is exactly the wanted `label`; the smallest when several are."""
    one = labels.groupBy("label").agg(F.min("hub_uri").alias("hub_uri"))
    return wanted.filter("label <> ''").join(one, "label").select("id", "hub_uri")


def label_hits(wanted: DataFrame, labels: DataFrame, search) -> DataFrame:
    """`id, uri, aLabel, token` of the hub whose access point is exactly the wanted `label`.

    Its `aLabel` is that of the first hit of a search for the label, which may be another hub's, and without a hit the wanted
    one; the URI is the label's own in any case. `search(queries(id, query)) -> (id, position, uri, aLabel)`.
    """
    found = wanted.join(by_label(wanted, labels), "id")
    first = search(found.select("id", F.col("label").alias("query"))).filter("position = 1").select("id", "aLabel")
    return found.join(first, "id", "left").select("id", F.col("hub_uri").alias("uri"), F.coalesce("aLabel", "label").alias("aLabel"), X.basename(F.col("hub_uri")).alias("token"))


def label_cascade(records: DataFrame, labels: DataFrame, suggest) -> DataFrame:
    """`id, hub_uri, strategy` by four strategies in turn: the label of author and uniform title, of the uniform title, a
    search for author and title, and for the title. `suggest(queries(id, query)) -> (id, uri)` is the search.
    """
    kinds = [
        ("label_author_uniform", X.access_point(F.col("author"), F.col("uniform_title"))), ("label_uniform", F.nullif("uniform_title", F.lit(""))),
        ("suggest_author_title", X.access_point(F.col("author"), F.col("title"))), ("suggest_title", F.nullif("title", F.lit(""))),
    ]
    out, rest = None, records
    for name, text in kinds:
        asked = rest.select("id", text.alias("label")).filter("label is not null")
        got = by_label(asked, labels) if name.startswith("label") else suggest(asked.withColumnRenamed("label", "query")).select("id", F.col("uri").alias("hub_uri"))
        got = got.withColumn("strategy", F.lit(name))
        out = got if out is None else out.unionByName(got)
        rest = rest.join(got.select("id"), "id", "left_anti")
    return records.select("id").join(out, "id", "left").select("id", "hub_uri", F.coalesce("strategy", F.lit("none")).alias("strategy"))


def suggest_search(queries: DataFrame, hits: DataFrame, count: int = 20, left_anchored: bool = False) -> DataFrame:
    """`id, position, uri, aLabel`: hits `uri, aLabel` that hold every word of `query`, or begin with it, up to `count` each."""
    # Hits with one label differ by their URI alone, so no more than `count` of them can be among the first.
    if count == 1:
        h = hits.groupBy("aLabel").agg(F.min("uri").alias("uri")).select("uri", "aLabel")
    else:
        same = Window.partitionBy("aLabel").orderBy("uri")
        h = hits.select("uri", "aLabel").distinct().withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= count).drop("nth")
    asked = queries.select("query").filter("query <> ''").distinct()
    if left_anchored:
        # An equi-join on the beginnings of the labels, of every length that a query has; however many labels begin alike, a
        # query meets only its own.
        # The shortest label that begins with a query is the query itself, so one with `count` such hits needs no beginnings.
        # Labels that change their length in lower case have no part in that, as they are ordered by their own length.
        asked = asked.withColumn("low", F.lower("query"))
        h = h.withColumn("low", F.lower("aLabel"))
        plain = F.length("low") == F.length("aLabel")
        equal = asked.join(h.filter(plain), "low")
        served = equal.groupBy("query").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= count).select("query")

        def begun(q: DataFrame, labels: DataFrame) -> DataFrame:
            lengths = q.agg(F.collect_set(F.length("low"))).scalar()
            each = labels.withColumn("n", F.explode(lengths)).filter(F.length("low") >= F.col("n"))
            return q.join(each.select("uri", "aLabel", F.substr("low", F.lit(1), F.col("n")).alias("low")), "low")

        columns = ["query", "uri", "aLabel"]
        longer = begun(asked.join(served, "query", "left_anti"), h.filter(plain)).filter(F.lower("aLabel") != F.lower("query"))
        met = equal.select(*columns).unionByName(longer.select(*columns)).unionByName(begun(asked, h.filter(~plain)).select(*columns))
    else:
        split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
        # Only the query's rarest word is joined on; the others are looked for in what that brings, by their hashes.
        q, t = asked.withColumn("words", split(F.col("query"))), h.withColumn("held", split(F.col("aLabel")))
        hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
        post = t.select("uri", "aLabel", hashes("held").alias("held"), F.explode("held").alias("token"))
        often = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        rare = q.select("query", "words", F.explode("words").alias("token")).join(often, "token").groupBy("query").agg(F.min(F.struct("df", "token")).alias("r"), F.first(hashes("words")).alias("words"))
        met = rare.select("query", "words", F.col("r.token").alias("token")).join(post, "token").filter(F.size(F.array_except("words", "held")) == 0)
    w = Window.partitionBy("query").orderBy(F.length("aLabel"), "aLabel", "uri")
    top = met.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= count).select("query", "position", "uri", "aLabel")
    return queries.select("id", "query").join(top, "query").select("id", "position", "uri", "aLabel")


def base_work(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """`id, hub_uri`: the hub of the base label of `hits(id, aLabel)`; none where nothing was stripped."""
    b = hits.select("id", "aLabel", X.base_label(F.col("aLabel")).alias("label")).filter("label <> aLabel")
    return by_label(b.select("id", "label"), labels)


def siblings(hits: DataFrame, candidates: DataFrame, count: int = 20) -> DataFrame:
    """Other hubs of the same base work: a search for the base label."""
    return suggest_search(hits.select("id", X.base_label(F.col("aLabel")).alias("query")), candidates, count)


def verified(hits: Column, lccn: Column) -> Column:
    """Whether any hit has the record's LCCN among its identifiers, blanks apart; it filters nothing."""
    want = X.strip_spaces(lccn)
    return F.coalesce((want != "") & F.exists(hits, lambda h: F.exists(F.coalesce(h["more"]["identifiers"], F.array().cast("array<string>")), lambda i: X.strip_spaces(i) == want)), F.lit(False))
