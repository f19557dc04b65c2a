"""URI and relation-type normal forms, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HUB_PATH = "/resources/hubs/"

#: Blanks that may stand around a value, no-break space included.
_BLANK = r"[\s\u00a0]"


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


#: Blanks, a URI path, `ns<digits>__`, the slug, any `_inbound`, slashes and blanks, over lower-case text.
_SLUG = rf"(?s)^{_BLANK}*(?:[a-z][a-z0-9+.-]*://\S*[/#](?=[^/\s]))?(?:ns\d+__)?(.*?)(?:_inbound)*/*{_BLANK}*$"


def bare_slug(c: Column) -> Column:
    """A relation type as a bare lower-case slug, or null when null or blank.

    Outer blanks, a URI path before the slug, a prefix `ns<digits>__`, an ending `_INBOUND` and letter case do not count.
    """
    return F.nullif(F.regexp_extract(F.lower(c), _SLUG, 1), F.lit(""))


#: How a URI with a hub path begins; cheap, as it never looks past the path's first character.
_HUB_START = rf"^{_BLANK}*(?i:https?)://[^/?#\s]+{HUB_PATH}[^?#/\s\u00a0]"
#: Host and path of a hub URI, without suffix, final slashes, blanks, query and fragment.
_HUB = rf"(?s)^{_BLANK}*(?i:https?)://([^/?#\s]+)({HUB_PATH}[^?#]*?[^?#/\s\u00a0])/*(?:\.(?i:rdf|json|html))?/*{_BLANK}*(?:[?#].*)?$"


def is_hub_uri(c: Column) -> Column:
    """Whether a URI has a path `/resources/hubs/...`."""
    return c.rlike(_HUB_START)


def hub_name(c: Column) -> Column:
    """The hub that a URI with a hub path names, as `host/resources/hubs/<id>`.

    Scheme, case of the host, outer blanks, fragment, query, final slashes and one suffix `.rdf`, `.json` or `.html`
    do not count. Only to be used where `is_hub_uri` holds.
    """
    x = F.regexp_replace(c, _HUB, "$1$2")
    return F.concat(F.lower(F.substring_index(x, "/", 1)), F.substr(x, F.instr(x, "/")))


def hub_key(c: Column) -> Column:
    """`hub_name`, or null where the path is not `/resources/hubs/...`."""
    return F.when(is_hub_uri(c), hub_name(c))
