"""RDF/XML of hubs: payloads that can be used, and what they say of a hub and its relations."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.dims import INLINE_TYPE, VOCABULARY_TYPES
from kinweave.functions import exprs as X
from kinweave.session import python_path

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
_ROW = "uri string, title string, agents array<string>, media array<string>, relations array<struct<targetUri:string,relType:string,title:string,isDirect:boolean>>"
#: Predicates that link hubs without a relation of their own.
_DIRECT = ("translationOf", "relatedTo", "arrangementOf")


def usable(payloads: DataFrame) -> DataFrame:
    """Payloads `hub_uri, http_status, content_type, body` that were served, are not empty and are not a web page."""
    return payloads.filter((F.col("http_status") == 200) & (F.col("body") != "") & ~X.is_html(F.col("content_type"), F.col("body")))


class Parser:
    """Reads one payload at a time; elements are told by namespace, whatever their prefix."""

    def __init__(self, config: Config = Config()):
        self.bf = f"{{{config.ontology}}}"
        self.vocabulary = {f"{config.relationship_prefixes[0]}{t}": t for t in VOCABULARY_TYPES}
        self.about = f"{{{RDF}}}about"
        self.resource = f"{{{RDF}}}resource"

    def _find(self, node: ElementTree.Element, path: str) -> Iterator[ElementTree.Element]:
        return (e for e in node.iterfind(".//" + "/".join(self.bf + p for p in path.split("/"))))

    def title(self, node: ElementTree.Element | None) -> str | None:
        if node is None:
            return None
        for kind in ("Title", "VariantTitle"):
            for e in self._find(node, f"title/{kind}/mainTitle"):
                return "".join(e.itertext()).strip()
        return None

    def relation_type(self, node: ElementTree.Element) -> str:
        kinds = []
        for e in node.iter(f"{self.bf}Relationship"):
            about = e.get(self.about) or ""
            label = "".join(x.itertext()).strip() if (x := e.find(f"{{{RDFS}}}label")) is not None else ""
            if "/entities/relationships/" in about:
                return urlsplit(about).path.rstrip("/").rpartition("/")[2].lower()
            if label and label != "related work":
                if label in INLINE_TYPE:
                    return INLINE_TYPE[label]
                plain = regex.sub(r"[\s()]+", "", regex.sub(r"\s*\((?:work|expression)\)\s*$", "", label)).lower()
                kinds += [plain] if plain else []
            if about in self.vocabulary:
                kinds.append(self.vocabulary[about])
        return next((k for k in kinds if k != "relatedwork"), "relatedwork")

    def _target(self, node: ElementTree.Element) -> str | None:
        if uri := node.get(self.about) or node.get(self.resource):
            return uri
        return next((e.get(self.about) for e in node.iter(f"{self.bf}Hub") if e is not node and e.get(self.about)), None)

    def parse(self, uri: str, body: str | None) -> tuple | None:
        """`(uri, title, agents, media, relations)`, or None for malformed input. Relations are in document order, not yet one per target."""
        try:
            parser = ElementTree.XMLParser(encoding="utf-8")
            parser.feed((body or "").encode("utf-8", "surrogatepass"))
            root = parser.close()
        except (ElementTree.ParseError, ValueError):
            return None
        works = list(root.iter(f"{self.bf}Work"))
        work = next((w for w in works if w.get(self.about) == uri), works[0] if works else None)
        scope = root if work is None else work
        agents, media, relations = [], [], []
        if work is not None:
            agents = [a.get(self.about) for c in work.findall(f"{self.bf}contribution") for a in self._find(c, "agent/Agent") if a.get(self.about)]
            media = [t.get(self.resource) for t in work.findall(f"{{{RDF}}}type") if t.get(self.resource)]
        for node in scope.iter(f"{self.bf}relation"):
            hub = next((h for h in node.iter(f"{self.bf}Hub") if "/resources/hubs/" in (h.get(self.about) or "")), None)
            if hub is not None:
                relations.append((hub.get(self.about), self.relation_type(node), self.title(hub), False))
        for name in _DIRECT:
            for node in scope.iter(f"{self.bf}{name}"):
                if target := self._target(node):
                    relations.append((target, name.lower(), self.title(node), True))
        return uri, self.title(work), list(dict.fromkeys(agents)), list(dict.fromkeys(media)), relations


def one_per_target(relations: list[tuple]) -> list[tuple]:
    """The first relation of each target, unless it is `relatedwork` and another is not."""
    seen: dict[str, tuple] = {}
    for r in relations:
        if r[0] not in seen or seen[r[0]][1] == "relatedwork" != r[1]:
            seen[r[0]] = r
    return list(seen.values())


def parse(payloads: DataFrame, config: Config = Config(), dedup: bool = True) -> DataFrame:
    """What the payloads `hub_uri, body` say, as in `kinweave.model.PARSED_RDF`; malformed ones give no row."""
    python_path(payloads.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(config)
        for pdf in batches:
            rows = [r for u, b in zip(pdf["hub_uri"], pdf["body"]) if (r := parser.parse(u, b)) is not None]
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=["uri", "title", "agents", "media", "relations"])
            names = ("targetUri", "relType", "title", "isDirect")
            out["relations"] = [[dict(zip(names, x)) for x in (one_per_target(r) if dedup else r)] for r in out["relations"]]
            yield out

    return payloads.select("hub_uri", "body").mapInPandas(run, _ROW)


def relations(parsed: DataFrame) -> DataFrame:
    """`source_uri, target_uri, rel_type, title, is_direct, seq` of parsed payloads, in document order."""
    return parsed.select(F.col("uri").alias("source_uri"), F.posexplode("relations").alias("seq", "r")).select(
        "source_uri", F.col("r.targetUri").alias("target_uri"), F.col("r.relType").alias("rel_type"), F.col("r.title").alias("title"), F.col("r.isDirect").alias("is_direct"), "seq"
    )


def dedup_relations(rel: DataFrame) -> DataFrame:
    """The same rule over a table of relations with `seq`: the first one per target, specific types before `relatedwork`."""
    best = rel.groupBy("source_uri", "target_uri").agg(F.min(F.struct((F.col("rel_type") == "relatedwork").alias("generic"), "seq", "rel_type", "is_direct")).alias("b"))
    return best.select("source_uri", "target_uri", "b.rel_type", "b.is_direct", "b.seq")
