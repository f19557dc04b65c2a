"""Scalar functions over Columns; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.dims import BASES, DEFAULT_TIER, LABEL_OF, TIER_OF

INBOUND = "_INBOUND"
TRAILING = " /;:,."


def _empty() -> Column:
    return F.array().cast("array<string>")


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key)


# Relation types


def relation_slug(uri: Column, config: Config) -> Column:
    """A relation type URI without either vocabulary's prefix; null becomes `related`."""
    for prefix in config.relationship_prefixes:
        uri = F.replace(uri, F.lit(prefix))
    return F.coalesce(uri, F.lit("related"))


def clean_type(rel_type: Column) -> Column:
    """The lower-case type without its direction."""
    return F.lower(F.replace(rel_type, F.lit(INBOUND)))


def tier(slug: Column) -> Column:
    """1 to 5, and 3 for an unlisted type; letter case does not count."""
    s, w = F.lower(slug), F
    for t in BASES:
        if t != DEFAULT_TIER:
            w = w.when(s.isin([x for x, own in TIER_OF.items() if own == t]), t)  # long lists become hash sets
    return w.otherwise(F.lit(DEFAULT_TIER))


def base_score(tier_: Column) -> Column:
    return _lookup({k: float(v) for k, v in BASES.items()}, tier_)


def label(rel_type: Column) -> Column:
    """The human label of a type: listed with or without its namespace, else the type without `of` or `for`, capitalised."""
    c = clean_type(rel_type)
    bare = F.regexp_replace(c, r"^ns\d+__", "")
    known = F.create_map(*[F.lit(x) for kv in sorted(LABEL_OF.items()) for x in kv])
    short = F.regexp_replace(bare, "(of|for)$", "")
    return F.coalesce(F.try_element_at(known, c), F.try_element_at(known, bare), F.concat(F.upper(F.substring(short, 1, 1)), F.substr(short, F.lit(2))))


# The score


def rarity_bonus(freq: Column, max_freq: Column) -> Column:
    """0 to 10, rarer is more; 5 when nothing is known of the frequency."""
    known = (freq > 0) & (max_freq > 0)
    return F.when(known, 10.0 * (1.0 - F.log10(freq.cast("double") + 1.0) / F.log10(max_freq.cast("double") + 1.0))).otherwise(F.lit(5.0))


def author_bonus(source: Column, target: Column) -> Column:
    """15 for no common agent, 8 for some, 0 for all, 5 when either side has none."""
    s, t = F.coalesce(source, _empty()), F.coalesce(target, _empty())
    common, most = F.size(F.array_intersect(s, t)), F.greatest(F.size(s), F.size(t))
    return F.when((F.size(s) == 0) | (F.size(t) == 0), 5.0).when(common == 0, 15.0).when(common < most, 8.0).otherwise(0.0)


def specific_media(media: Column, config: Config) -> Column:
    """Media types without those that every work has."""
    return F.array_except(F.coalesce(media, _empty()), F.array(*[F.lit(m) for m in config.generic_media]))


def medium_bonus(source: Column, target: Column) -> Column:
    """10 for disjoint specific media, 8 when only the target has any, 3 when only the source has, else 0."""
    ns, nt = F.size(source), F.size(target)
    return F.when((ns > 0) & (nt > 0) & (F.size(F.array_intersect(source, target)) == 0), 10.0).when((ns == 0) & (nt > 0), 8.0).when((ns > 0) & (nt == 0), 3.0).otherwise(0.0)


def clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def different_author(source: Column, target: Column) -> Column:
    s, t = F.coalesce(source, _empty()), F.coalesce(target, _empty())
    return (F.size(s) > 0) & (F.size(t) > 0) & (F.size(F.array_intersect(s, t)) == 0)


# Text


def basename(uri: Column) -> Column:
    return F.substring_index(F.rtrim(uri, F.lit("/")), "/", -1)


def strip_article(title: Column) -> Column:
    return F.regexp_replace(F.trim(title), r"(?i)^(the|a|an)\s+", "")


def words(title: Column) -> Column:
    return F.split(title, r"\s+")


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def trim_punctuation(c: Column, chars: str = TRAILING) -> Column:
    return F.rtrim(c, F.lit(chars))


def contains_ignoring_case(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lit(part.lower()))


def access_point(author: Column, title: Column) -> Column:
    """`author. title`, or null when either is missing or empty."""
    return F.when((author != "") & (title != ""), F.concat(author, F.lit(". "), title))


# Qualifiers that make a label another's derivative, in the order they are tried.
_QUALIFIERS = (
    r"(?i)\.\s+(Selections|Libretto|Vocal score|Piano score)(\.|$)",
    r"(?i)\.\s+(Act\s+\d+.*?)$",
    r"\.\s+[A-Z][a-z]+(\s+&\s+[A-Z][a-z]+)?$",
    r"\s+\([^)]+\)$",
)


def base_label(text: Column) -> Column:
    """The label after the first qualifier rule that changes it and leaves something; else the label itself."""
    out = reduce(lambda w, q: w.when((F.regexp_replace(text, q, "") != text) & (F.regexp_replace(text, q, "") != ""), F.regexp_replace(text, q, "")), _QUALIFIERS, F.when(F.lit(False), text))
    return out.otherwise(text)


def percent_encode(c: Column) -> Column:
    """As in URL paths: all but letters, digits and `-_.~` in per cent form."""
    x = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def query_encode(c: Column) -> Column:
    """As in query strings: blanks become `+`."""
    return F.url_encode(c)


def url_path(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PATH"))


def is_hub(c: Column, config: Config) -> Column:
    return c.rlike(config.hub_pattern)


def rdf_url(c: Column) -> Column:
    """Where a hub's RDF is served: https, no final slash, one `.rdf`."""
    x = F.rtrim(F.regexp_replace(c, "^http://", "https://"), F.lit("/"))
    return F.when(x.endswith(".rdf"), x).otherwise(F.concat(x, F.lit(".rdf")))


def validation_url(c: Column, config: Config) -> Column:
    """The address that is checked: the catalogue's own URIs with `.rdf` unless they name a serialisation."""
    own = F.contains(c, F.lit(config.host)) & ~c.rlike(r"(?i)\.(rdf|json|nt|ttl|xml)$")
    return F.when(own, F.concat(c, F.lit(".rdf"))).otherwise(c)


def is_html(content_type: Column, body: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("html")), F.lit(False)) | F.coalesce(F.ltrim(body).startswith("<!DOCTYPE"), F.lit(False))


def fresh(checked_at: Column, as_of: Column, ttl_seconds: int) -> Column:
    """Whether a cache entry is still valid at `as_of`."""
    return F.unix_micros(as_of) - F.unix_micros(checked_at) < ttl_seconds * 1_000_000
