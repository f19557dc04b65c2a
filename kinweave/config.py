"""Settings and the vocabulary namespaces that depend on the catalogue's host."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields


def truthy(value: object) -> bool:
    """Any value is true but false itself and the text `false`."""
    return value is not False and value != "false"


def http_endpoint(uri: str) -> str:
    """The HTTP endpoint of a graph server's bolt address: port 7687 becomes 7474, `bolt+s` becomes https."""
    scheme, _, rest = uri.partition("://")
    secure = scheme in ("bolt+s", "https")
    host = rest.split("/")[0]
    name, _, port = host.partition(":")
    port = "7474" if port in ("", "7687") else port
    return f"{'https' if secure else 'http'}://{name}:{port}"


@dataclass(frozen=True)
class Config:
    """Every setting with its default. `host` is where hub and vocabulary URIs live."""

    host: str = "id.catalog.example"
    timeout: int = 10
    max_results: int = 20
    graph_enabled: bool = False
    frequency_ttl: int = 86_400
    validate_uris: bool = True
    validation_ttl: int = 86_400
    max_display: int = 15
    empty_rdf_ttl: int = 86_400
    title_candidates: int = 30
    #: Of our own relevance score, which is not comparable with any other engine's.
    title_threshold: float = 0.0

    @property
    def ontology(self) -> str:
        return f"http://{self.host}/ontologies/bibframe/"

    @property
    def relationship_prefixes(self) -> tuple[str, str]:
        return f"http://{self.host}/vocabulary/relationship/", f"http://{self.host}/entities/relationships/"

    @property
    def hub_pattern(self) -> str:
        return rf"https?://{self.host.replace('.', chr(92) + '.')}/resources/hubs/"

    @property
    def generic_media(self) -> tuple[str, str]:
        return f"{self.ontology}Hub", f"{self.ontology}Work"

    @classmethod
    def from_ini(cls, path: str) -> Config:
        """Settings from an INI file's sections `Connection`, `Graph` and `Display`; missing ones keep their defaults."""
        ini = configparser.ConfigParser()
        ini.optionxform = str
        ini.read(path)
        keys = {
            "timeout": ("Connection", "timeout"), "max_results": ("Connection", "maxResults"), "host": ("Connection", "host"), "graph_enabled": ("Graph", "enabled"), "frequency_ttl": ("Graph", "frequencyCacheTtl"),
            "validate_uris": ("Display", "validateUris"), "validation_ttl": ("Display", "validationCacheTtl"), "max_display": ("Display", "maxDisplayResults"), "empty_rdf_ttl": ("Display", "emptyRdfCacheTtl"),
        }
        got = {}
        for f in fields(cls):
            section, key = keys.get(f.name, ("", ""))
            if ini.has_option(section, key):
                text = ini.get(section, key).strip().strip("\"'")
                got[f.name] = truthy(text) if f.type == "bool" else int(text) if f.type == "int" else text
        return cls(**got)
