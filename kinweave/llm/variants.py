"""Variant spellings of one person or organisation.

Distinct names become character n-gram vectors weighted by rarity, over all their words in any order; a distributed sparse
join finds every pair of vectors above a cosine. Average linkage groups the names by these cosines, run as rounds of merging
mutual nearest neighbours: these rounds give the same tree as merging the closest pair each time, and no cluster, component
or link set is ever brought into one task. A pair whose parts contradict each other (dates, given names, subjects of bodies)
is a conflict, whatever its cosine. Which given names are short forms of others is learned from the headings themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm import names
from kinweave.llm.meeting import meet
from kinweave.session import checkpoint, python_path, spread

#: Length of the n-grams of words up to, and of words from, so many letters: a typing error leaves a short word short n-grams
#: in common, while those of long words can be long and rare.
SHORT, LONG, LENGTH = 3, 5, 7
#: Cosine from which two names are compared.
COSINE = 0.35
#: Mean cosine from which clusters are merged.
LINKAGE = 0.25
#: Similarity of two names that contradict each other; outweighs any number of others in small clusters.
CONFLICT = -4.0
#: A given name stands for a fuller one if both occur under at least so many same family names, and in at least this share of
#: the family names under which the short one occurs beside any other. So no name has more than 1 / SHORT_SHARE fuller ones.
SHORT_FAMILIES, SHORT_SHARE = 2, 0.15


def grams(text: str) -> dict[str, int]:
    """Character n-grams of each padded word with their counts; a very short word is a gram of its own."""
    out: dict[str, int] = {}
    for w in text.split():
        s = f"^{w}$"
        for n in ((SHORT,) if len(w) <= LENGTH else ()) + ((LONG,) if len(w) >= LENGTH else ()):
            for i in range(max(1, len(s) - n + 1)):
                out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
    return out


def weight(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    return tf * np.log1p(n / df) ** 1.5


def similar_texts(nodes: DataFrame, cosine: float = COSINE, top_n: int | None = None) -> DataFrame:
    """All pairs of distinct `nodes(node, text)` whose n-gram vectors have at least this cosine: `a, b, cosine`, a < b.

    Grams that no other node has can be shared with none, and are left out of the vectors: most are typing errors.
    Grams are ordered by rarity, and each vector is looked up under so many of its rarest grams that what remains has a norm
    below the cosine: two vectors at the cosine share one of them. What they have in common there, and the product of the
    norms of what follows the last gram they share there, bound their cosine from above, so that few pairs need their whole
    vectors. `top_n` keeps only the best pairs of each node; by default none is dropped.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(node, g, tf) for node, text in zip(pdf["node"], pdf["text"]) for g, tf in grams(text).items()]
            yield pd.DataFrame(out, columns=["node", "gram", "tf"])

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for node, gs, dfs, tfs in zip(*(pdf[c] for c in ("node", "gram", "df", "tf"))):
                w = weight(np.asarray(tfs, float), np.asarray(dfs, float), n)
                w /= np.linalg.norm(w)
                rest = np.sqrt(np.cumsum((w**2)[::-1])[::-1])  # norm of this gram and the commoner ones
                keep = int((rest >= cosine - 1e-9).sum())
                out.append((node, list(gs[:keep]), [*rest[1:], 0.0][:keep], list(gs), w.tolist()))
            yield pd.DataFrame(out, columns=["node", "keep", "after", "grams", "weights"])

    n = max(nodes.count(), 1)
    each = checkpoint(nodes.select("node", "text").mapInPandas(split, "node long, gram string, tf int"))
    rarity = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    vectors = checkpoint(
        each.join(spread(rarity), "gram")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("df", "gram", "tf"))).alias("v"))
        .select("node", "v.gram", "v.df", "v.tf")
        .mapInPandas(bound, "node long, keep array<string>, after array<double>, grams array<string>, weights array<double>")
    )
    keys = vectors.select("node", F.inline(F.arrays_zip("keep", "after", F.slice("weights", F.lit(1), F.size("keep")).alias("w"))))
    met = meet(keys.toDF("l", "key", "after_l", "w_l"), keys.toDF("r", "key", "after_r", "w_r")).filter("l < r")
    most = F.sum(F.col("w_l") * F.col("w_r")) + F.min(F.col("after_l") * F.col("after_r"))
    met = met.groupBy(F.col("l").alias("a"), F.col("r").alias("b")).agg(most.alias("most")).filter(F.col("most") >= cosine - 1e-9).select("a", "b")
    va = vectors.select(F.col("node").alias("a"), F.map_from_arrays("grams", "weights").alias("va"))
    vb = vectors.select(F.col("node").alias("b"), F.map_from_arrays("grams", "weights").alias("vb"))
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, g: s + F.col("va")[g] * F.coalesce(F.try_element_at("vb", g), F.lit(0.0)))
    pairs = met.join(spread(va), "a").join(spread(vb), "b").select("a", "b", dot.alias("cosine")).filter(F.col("cosine") >= cosine - 1e-9)
    if top_n is not None:
        both = pairs.select(F.col("a").alias("x"), "*").unionByName(pairs.select(F.col("b").alias("x"), "*"))
        w = Window.partitionBy("x").orderBy(F.desc("cosine"), "a", "b")
        pairs = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).select("a", "b", "cosine").distinct()
    return pairs


def _id(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a heading says, and the text of its vector; headings that say the same have one profile."""
    for pdf in batches:
        out = []
        for author, dates in zip(pdf["author"], pdf["dates"]):
            read = names.readings(author, dates)
            x = read[0]
            if x.kind == "none":
                continue
            text = " ".join(sorted((*x.family, *x.given)))
            given = list(dict.fromkeys(w for r in read for w in r.given)) if x.kind == "person" else []
            out.append((author, dates, _id(repr(read)), _id(text), text, given, x.given[0] if len(read) == 1 and given else None))
        yield pd.DataFrame(out, columns=["author", "dates", "profile", "node", "text", "given", "first"])


_PROFILE = "author string, dates string, profile long, node long, text string, given array<string>, first string"


def short_forms(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """`given, fuller`: given names that stand for another, more frequent one, as learned from `pairs` of similar names.

    Of two names for one person the family name is the same and the given names are not; so are those of relatives, but
    theirs are any two names, while a short form keeps coming back with the few names that it stands for.
    """

    def related(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = (names.kin(names.readings(x, p), names.readings(y, q)) for x, p, y, q in zip(pdf["author_a"], pdf["dates_a"], pdf["author_b"], pdf["dates_b"]))
            yield pd.DataFrame([g for g in got if g], columns=["family", "g", "h"])

    both = pairs.mapInPandas(related, "family string, g string, h string").distinct()
    seen = both.select("family", F.inline(F.array(F.struct(F.col("g").alias("given"), F.col("h").alias("fuller")), F.struct(F.col("h").alias("given"), F.col("g").alias("fuller")))))
    together = seen.groupBy("given", "fuller").agg(F.count(F.lit(1)).alias("n"))
    alone = seen.groupBy("given").agg(F.count_distinct("family").alias("families"))
    often = profiles.filter("first is not null").groupBy("first").agg(F.count(F.lit(1)).alias("uses"))
    uses = lambda name: often.select(F.col("first").alias(name), F.col("uses").alias(f"{name}_uses"))
    known = together.filter(F.col("n") >= SHORT_FAMILIES).join(alone, "given").filter(F.col("n") >= SHORT_SHARE * F.col("families"))
    known = known.join(uses("given"), "given", "left").join(uses("fuller"), "fuller").filter(F.coalesce("given_uses", F.lit(0)) < F.col("fuller_uses"))
    return known.select("given", "fuller")


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sims = []
        for x, p, y, q, fa, fb, cosine in zip(*(pdf[c] for c in ("author_a", "dates_a", "author_b", "dates_b", "fulls_a", "fulls_b", "cosine"))):
            fulls: names.Fulls = {}
            for r in (*(fa if fa is not None else ()), *(fb if fb is not None else ())):
                fulls[r["given"]] = (*fulls.get(r["given"], ()), r["fuller"])
            sims.append(cosine if names.best_agreement(names.readings(x, p), names.readings(y, q), fulls) > 0 else CONFLICT)
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "sim": sims})


def average_linkage(edges: DataFrame, least: float = LINKAGE) -> DataFrame:
    """Clusters of average linkage over `edges(a, b, sim)`, each unordered pair once: `node, cluster` of every node that was merged.

    A pair without an edge counts as similarity 0. Ties are broken by the identifiers, so the result is the same each run.
    """
    one = F.lit(1).cast("long")
    edges = checkpoint(edges.select("a", "b", F.col("sim").alias("total"), one.alias("na"), one.alias("nb")))
    rounds: list[DataFrame] = []
    while True:
        mean = F.col("total") / (F.col("na") * F.col("nb"))
        near = edges.withColumn("mean", mean).filter(F.col("mean") >= least)
        rank = F.struct(F.col("mean"), (-F.col("a")).alias("ra"), (-F.col("b")).alias("rb"))
        best = near.select(F.explode(F.array("a", "b")).alias("x"), rank.alias("rank"), F.struct("a", "b", "na", "nb").alias("p")).groupBy("x").agg(F.max_by("p", "rank").alias("p"))
        # The pair that both of its ends chose.
        pairs = checkpoint(best.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("p.b").alias("gone"), F.col("p.a").alias("into"), (F.col("p.na") + F.col("p.nb")).alias("size")))
        if pairs.isEmpty():
            break
        rounds.append(pairs)
        # Relabel the ends, with the size of what they now belong to, and add up what joins the same clusters. A move stands
        # beside the edges of its node rather than being joined to them: Catalyst multiplies the sizes of joined tables, and over
        # the rounds its estimate would triple its digits each time, until the number alone fills the driver.
        moved = pairs.select(F.explode(F.array("gone", "into")).alias("node"), "into", "size")
        e = edges
        for end, size in (("a", "na"), ("b", "nb")):
            m = moved.select(F.col("node").alias(end), F.col("into").alias("to"), "size")
            at = Window.partitionBy(end)
            e = e.unionByName(m, allowMissingColumns=True).withColumns({"to": F.max("to").over(at), "size": F.max("size").over(at)}).filter("total is not null")
            e = e.withColumns({end: F.coalesce("to", end), size: F.coalesce("size", size)}).drop("to", "size")
        swap = F.col("a") > F.col("b")
        e = e.filter("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")
        )
        edges = checkpoint(e.groupBy("a", "b").agg(F.sum("total").alias("total"), F.max("na").alias("na"), F.max("nb").alias("nb")))
    # Where each node ended: the rounds' moves one after the other.
    if not rounds:
        return pairs.select(F.col("gone").alias("node"), F.col("into").alias("cluster"))
    nodes = reduce(DataFrame.unionByName, [p.select(F.explode(F.array("gone", "into")).alias("node")) for p in rounds]).distinct().withColumn("cluster", F.col("node"))
    for p in rounds:
        nodes = nodes.join(p.select(F.col("gone").alias("cluster"), "into"), "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
    return checkpoint(nodes)


def similar_profiles(profiles: DataFrame) -> DataFrame:
    """`a, b, cosine` and the headings of every two profiles with the same or similar words."""
    one = profiles.groupBy("profile", "node").agg(F.min(F.struct("author", "dates")).alias("h")).select("profile", "node", "h.author", "h.dates")
    close = similar_texts(profiles.select("node", "text").distinct())
    side = lambda x: one.select(F.col("node").alias(f"node_{x}"), F.col("profile").alias(x), F.col("author").alias(f"author_{x}"), F.col("dates").alias(f"dates_{x}"))
    across = close.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), "cosine").join(spread(side("a")), "node_a").join(spread(side("b")), "node_b")
    within = side("a").withColumn("node_b", F.col("node_a")).join(spread(side("b")), "node_b").filter("a < b").withColumn("cosine", F.lit(1.0))
    columns = ["a", "b", "cosine", "author_a", "dates_a", "author_b", "dates_b"]
    # The smaller profile comes first.
    flip = F.when(F.col("a") < F.col("b"), F.struct(*columns)).otherwise(F.struct(*[F.col(c.translate(str.maketrans("ab", "ba")) if c in "ab" else c[:-1] + {"a": "b", "b": "a"}[c[-1]] if c != "cosine" else c).alias(c) for c in columns]))
    return across.select(*columns).unionByName(within.select(*columns)).select(flip.alias("x")).select("x.*")


def variant_classes(df: DataFrame, key: str, author: str, dates: str | None = None) -> DataFrame:
    """`key, class` of every row with a name: rows of one class are variants of one person or organisation.

    Null, blank and wordless names belong to no class. Rows with the same name and dates always share one.
    """
    python_path(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(author).alias("author"), (F.col(dates) if dates else F.lit(None)).cast("string").alias("dates"))
    rows = rows.filter(F.col("author").rlike(r"[\p{L}]"))
    profiles = checkpoint(rows.select("author", "dates").distinct().mapInPandas(_profiles, _PROFILE))
    pairs = checkpoint(similar_profiles(profiles))
    known = short_forms(pairs, profiles)
    fuller = profiles.select("profile", F.explode("given").alias("given")).distinct().join(spread(known), "given").groupBy("profile").agg(F.collect_set(F.struct("given", "fuller")).alias("fulls"))
    fa, fb = (fuller.select(F.col("profile").alias(x), F.col("fulls").alias(f"fulls_{x}")) for x in "ab")
    edges = pairs.join(spread(fa), "a", "left").join(spread(fb), "b", "left").mapInPandas(_scored, "a long, b long, sim double")
    clusters = average_linkage(edges)
    p = profiles.select(F.col("author").alias("p_author"), F.col("dates").alias("p_dates"), "profile")
    classed = p.join(spread(clusters), F.col("profile") == F.col("node"), "left").select("p_author", "p_dates", F.coalesce("cluster", "profile").alias("class"))
    return rows.join(spread(classed), (F.col("author") == F.col("p_author")) & F.col("dates").eqNullSafe(F.col("p_dates"))).select("key", "class")


def variant_pairs(classes: DataFrame) -> DataFrame:
    """Every pair of different keys of one class, smaller first. The size of this listing is quadratic in a class by definition."""
    one = classes.select("key", "class").distinct()
    a, b = one.select(F.col("key").alias("a"), "class"), one.select(F.col("key").alias("b"), "class")
    return a.join(spread(b), "class").filter("a < b").select("a", "b").distinct()
