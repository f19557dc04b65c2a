"""RDF dumps: N-Triples in the JVM, Turtle by a reader of its own, and the graph tables from triples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.model import TRIPLE, Graph
from kinweave.session import broadcast_if_small, python_path

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_FIRST, RDF_REST, RDF_NIL = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{x}" for x in ("first", "rest", "nil"))
RDF_VALUE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#value"
_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
_NODE = r"^<|>$"


def _unescape(c: Column) -> Column:
    """Undoes a literal's escapes in one pass, so that what one escape gives is never read as part of another."""
    part = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), 0)
    plain = F.create_map(*[F.lit(x) for kv in {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}.items() for x in kv])

    def one(x: Column) -> Column:
        code = F.substr(x, F.lit(3))
        # UTF-32 is the code point itself, in four bytes.
        point = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        named = F.substr(x, F.lit(2))
        return F.when(~x.startswith("\\"), x).when(x.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), point).otherwise(F.coalesce(F.try_element_at(plain, named), named))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(part, one), "")).otherwise(c)


def _scope(path: Column) -> Column:
    """A prefix for a file's blank nodes, which are its own."""
    return F.lower(F.hex(F.xxhash64(path)))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """`s, p, o, o_is_iri, lang` of N-Triples files, split by line; bad addresses are kept as they are, other lines are left out."""
    t = spark.read.text(path).select(*[F.regexp_extract("value", _NT, i).alias(n) for i, n in enumerate(("s", "p", "o"), 1)], _scope(F.col("_metadata.file_path")).alias("file")).filter("p <> ''")
    literal = F.col("o").startswith('"')
    node = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("bnode://"), "file", F.lit("-"), F.substr(c, F.lit(3)))).otherwise(F.regexp_replace(c, _NODE, ""))
    return t.select(
        node(F.col("s")).alias("s"), "p", F.when(literal, _unescape(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))).otherwise(node(F.col("o"))).alias("o"),
        (~literal).alias("o_is_iri"), F.nullif(F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("lang"),
    )


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"\n]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<dt>\^\^)
    |(?P<punct>[;,\[\]()]|\.(?!\w))|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>(?:[^\s<>"'\[\]();,]|\.(?=\w))*[^\s<>"'\[\]();,.]|:)|(?P<other>.)""",
    re.X | re.S,
)


def turtle(text: str, scope: str = "") -> Iterator[tuple[str, str, str, bool, str | None]]:
    """Triples of a Turtle document. What cannot be read is skipped up to the next full stop, so one bad address costs no more.

    `scope` goes before the names of blank nodes, which no two documents share. Numbers, booleans and typed literals are read
    as their text.
    """
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text) if m.lastgroup]
    prefixes: dict[str, str] = {}
    base = ""
    at, fresh = 0, 0

    def iri(kind: str, s: str) -> str:
        if kind == "iri":
            u = s[1:-1]
            return u if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", u) else base + u
        if s == "a":
            return RDF_TYPE
        if s.startswith("_:"):
            return f"bnode://{scope}{s[2:]}"
        p, _, local = s.partition(":")
        if kind != "name" or p not in prefixes:
            raise ValueError(s)
        return prefixes[p] + local

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal at
        t = peek()
        at += 1
        return t

    def blank(out: list) -> str:
        nonlocal fresh
        fresh += 1
        node = f"bnode://{scope}genid{fresh}"
        if peek()[1] != "]":
            pairs(node, out, "]")
        take()
        return node

    def collection(out: list) -> str:
        nonlocal fresh
        head = at_node = None
        while peek()[1] not in (")", ""):
            fresh += 1
            node = f"bnode://{scope}genid{fresh}"
            if at_node is None:
                head = node
            else:
                out.append((at_node, RDF_REST, node, True, None))
            at_node = node
            out.append((node, RDF_FIRST, *obj(out)))
        take()
        if at_node is None:
            return RDF_NIL
        out.append((at_node, RDF_REST, RDF_NIL, True, None))
        return head

    def obj(out: list) -> tuple[str, bool, str | None]:
        kind, s = take()
        if s == "[":
            return blank(out), True, None
        if s == "(" and kind == "punct":
            return collection(out), True, None
        if kind in ("str", "long"):
            body = s[3:-3] if kind == "long" else s[1:-1]
            body = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), body, flags=re.S)
            lang = None
            if peek()[0] == "lang":
                lang = take()[1][1:]
            elif peek()[0] == "dt":
                take()
                take()
            return body, False, lang
        if kind == "num" or s in ("true", "false"):
            return s, False, None
        return iri(kind, s), True, None

    def pairs(subject: str, out: list, end: str) -> None:
        while True:
            while peek()[1] == ";":
                take()
            if peek()[1] in (end, ""):
                return
            p = iri(*take())
            while True:
                o = obj(out)
                out.append((subject, p, *o))
                if peek()[1] != ",":
                    break
                take()
            if peek()[1] not in (";", end):
                raise ValueError(peek()[1])

    while at < len(tokens):
        out: list = []
        try:
            kind, s = take()
            word = s.lower().lstrip("@")
            if word in ("prefix", "base") and kind in ("lang", "name"):
                if word == "prefix":
                    name = take()[1]
                    prefixes[name.rstrip(":")] = iri(*take())
                else:
                    base = iri(*take())
                if peek()[1] == ".":
                    take()
                continue
            subject = blank(out) if s == "[" else collection(out) if s == "(" else iri(kind, s)
            pairs(subject, out, ".")
            take()
        except ValueError:
            while at < len(tokens) and take()[1] != ".":
                pass
        yield from out


_DECLARATION = r"(?im)^\s*(?:@prefix|@base|prefix|base)\s[^\n]*"


def read_turtle(spark: SparkSession, path: str, end: str | None = " .\n") -> DataFrame:
    """`s, p, o, o_is_iri, lang` of Turtle files of any size.

    Files are split where a statement ends, which dumps write as a blank, a full stop and a new line; `end` names another way.
    What a piece needs of its file are the prefixes, which are read first. A file whose literals hold the separator, or that
    declares a prefix twice, has to be read whole, with `end=None`: then a file is one task.
    """
    python_path(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["s", "p", "o", "o_is_iri", "lang"]
        for pdf in batches:
            rows: list = []
            for file, head, body in zip(pdf["file"], pdf["head"], pdf["body"]):
                # Named blank nodes are those of the whole file, unnamed ones of this piece of it.
                own = f"{file}-{hashlib.blake2b(body.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}-"
                for t in turtle(f"{head or ''}\n{body} .\n" if end else body, f"{file}-"):
                    rows.append((*(x.replace(f"bnode://{file}-genid", f"bnode://{own}genid") if isinstance(x, str) and x.startswith("bnode://") else x for x in t),))
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    file = _scope(F.col("_metadata.file_path")).alias("file")
    if end is None:
        whole = spark.read.format("binaryFile").load(path).select(file, F.lit("").alias("head"), F.decode("content", "UTF-8").alias("body"))
        return whole.mapInPandas(run, TRIPLE)
    pieces = spark.read.option("lineSep", end).text(path).select(file, F.col("value").alias("body"))
    said = pieces.filter(F.col("body").rlike(_DECLARATION)).select(F.col("file").alias("of"), F.explode(F.regexp_extract_all("body", F.lit(_DECLARATION), 0)).alias("x"))
    # As many rows as there are files, each with the few lines that begin it.
    heads = said.groupBy("of").agg(F.array_join(F.transform(F.collect_set("x"), lambda x: F.concat(F.rtrim(x, F.lit(" .\t\r")), F.lit(" ."))), "\n").alias("head"))
    met = pieces.join(broadcast_if_small(heads), F.col("file") == F.col("of"), "left")
    body = F.regexp_replace("body", _DECLARATION, "").alias("body")
    return met.select("file", "head", body).filter(F.trim("body") != "").mapInPandas(run, TRIPLE)


def to_graph(triples: DataFrame, config: Config = Config()) -> Graph:
    """The graph tables from triples, by predicate."""
    bf = config.ontology

    def link(p: str, a: str, b: str) -> DataFrame:
        return triples.filter(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))

    hub = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == f"{bf}Hub")).select(F.col("s").alias("hub_uri")).distinct()
    title = link(f"{bf}title", "hub_uri", "title_node").join(
        triples.filter(F.col("p") == f"{bf}mainTitle").groupBy(F.col("s").alias("title_node")).agg(F.sort_array(F.collect_set("o")).alias("main_titles")), "title_node"
    )
    agent = link(f"{bf}contribution", "hub_uri", "c").join(link(f"{bf}agent", "c", "agent_uri"), "c").select("hub_uri", "agent_uri").distinct()
    identifier = link(f"{bf}identifiedBy", "hub_uri", "i").join(link(RDF_VALUE, "i", "id_value"), "i").select("hub_uri", "id_value")
    relation = link(f"{bf}relation", "source_uri", "relation_id").join(link(f"{bf}associatedResource", "relation_id", "target_uri"), "relation_id").select("relation_id", "source_uri", "target_uri").distinct()
    kinds = link(f"{bf}relationship", "relation_id", "type_uri").distinct()
    return Graph(hub, title.select("hub_uri", "title_node", "main_titles"), agent, link(RDF_TYPE, "hub_uri", "type_uri").join(hub, "hub_uri", "left_semi"), identifier, relation, kinds)
