"""Deeply nested semi-structured records into related flat tables.

One depth-first pass over each stored record (XML in any namespace prefix, or its JSON form) emits rows of all tables,
tagged with their table: `table, pk, parent_pk, payload`. The tagged rows can be written once, partitioned by tag, and
read back per table; `TABLES` gives each table's schema.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import python_path

TAGGED = "tag string, pk string, parent_pk string, id string, payload array<string>"
_ARROW = pa.schema([("tag", pa.string()), ("pk", pa.string()), ("parent_pk", pa.string()), ("id", pa.string()), ("payload", pa.list_(pa.string()))])

#: Column names and types of each table's payload, in order.
TABLES: dict[str, list[tuple[str, str]]] = {
    "record": [("leader", "string"), ("n_controls", "int"), ("n_fields", "int")],
    "control": [("control_seq", "int"), ("tag", "string"), ("value", "string")],
    "field": [("field_seq", "int"), ("tag", "string"), ("ind1", "string"), ("ind2", "string"), ("n_subfields", "int")],
    "subfield": [("field_seq", "int"), ("tag", "string"), ("sub_seq", "int"), ("code", "string"), ("value", "string")],
}


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _xml_records(text: str) -> Iterator[tuple[str | None, list, list]]:
    parser = ElementTree.XMLParser(encoding="utf-8")
    parser.feed(text.encode("utf-8", "surrogatepass"))
    root = parser.close()
    for rec in [root] if _local(root.tag) == "record" else [e for e in root.iter() if _local(e.tag) == "record"]:
        leader, controls, fields = None, [], []
        for e in rec:
            kind = _local(e.tag)
            if kind == "leader":
                leader = e.text or ""
            elif kind == "controlfield":
                controls.append((e.get("tag"), e.text or ""))
            elif kind == "datafield":
                subs = [(s.get("code"), "".join(s.itertext())) for s in e if _local(s.tag) == "subfield"]
                fields.append((e.get("tag"), e.get("ind1"), e.get("ind2"), subs))
        yield leader, controls, fields


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _json_records(text: str) -> Iterator[tuple[str | None, list, list]]:
    data = json.loads(text)
    for rec in data if isinstance(data, list) else [data]:
        if not isinstance(rec, dict) or not isinstance(rec.get("fields"), list):
            continue
        controls, fields = [], []
        for f in rec["fields"]:
            for tag, body in f.items() if isinstance(f, dict) else ():
                if isinstance(body, dict):
                    subs = [(c, _text(v)) for s in body.get("subfields") or () if isinstance(s, dict) for c, v in s.items()]
                    fields.append((tag, _text(body.get("ind1")), _text(body.get("ind2")), subs))
                else:
                    controls.append((tag, _text(body)))
        yield _text(rec.get("leader")), controls, fields


def visit(key: str | None, text: str | None) -> Iterator[tuple[str, str, str | None, str | None, list]]:
    """Tagged rows of one stored record, depth first; nothing for null, blank or malformed input."""
    if text is None:
        return
    body = text.lstrip("\ufeff")
    try:
        if body.lstrip()[:1] in ("{", "["):
            records = list(_json_records(body))
        else:
            records = list(_xml_records(body))
    except (ElementTree.ParseError, ValueError, RecursionError):
        return
    # A record that is delivered again in another state is another record, so its content is part of the key.
    base = f"{key or ''}#{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"
    for n, (leader, controls, fields) in enumerate(records):
        pk = f"{base}/{n}"
        yield "record", pk, None, key, [leader, str(len(controls)), str(len(fields))]
        for c, (tag, value) in enumerate(controls, 1):
            yield "control", f"{pk}/c{c}", pk, key, [str(c), tag, value]
        for f, (tag, ind1, ind2, subs) in enumerate(fields, 1):
            fk = f"{pk}/{f}"
            yield "field", fk, pk, key, [str(f), tag, ind1, ind2, str(len(subs))]
            for s, (code, value) in enumerate(subs, 1):
                yield "subfield", f"{fk}/{s}", fk, key, [str(f), tag, str(s), code, value]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out.extend(visit(key, text))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)


def flatten(df: DataFrame, key: str = "id", payload: str = "fullrecord") -> DataFrame:
    """Tagged rows of all tables for every stored record; a map-only plan, one pass over each payload.

    Null, empty and malformed payloads give no rows; exact repeats give the same keys again, so `distinct` removes them.
    """
    python_path(df.sparkSession)
    return df.select(F.col(key).cast("string").alias("key"), F.col(payload).alias("payload")).filter("payload is not null").mapInArrow(_emit, TAGGED)


def table(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table with its schema applied: `pk, parent_pk, id` and the columns of `TABLES[tag]`."""
    cols = [F.get("payload", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(TABLES[tag])]
    return tagged.filter(F.col("tag") == tag).select("pk", "parent_pk", "id", *cols)


def write_tables(tagged: DataFrame, path: str) -> None:
    """Write all tables in one pass, partitioned by tag; each can then be read with partition pruning."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark, path: str, tag: str) -> DataFrame:
    return table(spark.read.schema(TAGGED).parquet(path), tag)
