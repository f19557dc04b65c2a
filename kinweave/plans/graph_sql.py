"""DuckDB SQL of the projected graph and of the score, as text that the queries' oracles share."""

from __future__ import annotations

from kinweave.config import Config
from kinweave.dims import BASES, LABEL_OF, TIER_OF
from kinweave.sources.fixture import SLUGS

_C = Config()
_H = f"http://{_C.host}/resources/hubs/"
_BF = _C.ontology
_VOC, _ENT = _C.relationship_prefixes
_SLUGS = ", ".join(f"'{s}'" for s in SLUGS)

GRAPH = f"""
e AS (SELECT a.*, b.l_partkey AS b_part, a.l_orderkey || '-' || a.l_linenumber || '-' || a.l_partkey || '-' || b.l_partkey AS relation_id
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
g_hub AS (SELECT '{_H}' || p_partkey AS hub_uri FROM part),
g_title AS (SELECT '{_H}' || p_partkey AS hub_uri, 'title:' || p_partkey AS title_node, CASE WHEN p_size % 10 = 0 THEN [p_name, p_brand] ELSE [p_name] END AS main_titles FROM part),
g_type AS (SELECT '{_H}' || p_partkey AS hub_uri, '{_BF}Hub' AS type_uri FROM part
  UNION ALL SELECT '{_H}' || p_partkey, '{_BF}' || CASE p_type WHEN 'MEDIUM' THEN 'MovingImage' WHEN 'STANDARD' THEN 'Text' WHEN 'LARGE' THEN 'NotatedMusic' ELSE 'Audio' END
  FROM part WHERE p_type IN ('MEDIUM', 'STANDARD', 'LARGE', 'PROMO')),
g_agent AS (SELECT '{_H}' || p_partkey AS hub_uri, 'http://{_C.host}/rwo/agents/' || p_brand AS agent_uri FROM part WHERE p_size % 7 <> 0
  UNION SELECT '{_H}' || p_partkey, 'http://{_C.host}/rwo/agents/Brand#' || (1 + p_size % 25) FROM part WHERE p_size % 7 <> 0 AND p_size % 3 = 0),
g_identifier AS (SELECT hub_uri, CASE WHEN p_size % 2 = 0 THEN n[1:4] || ' ' || n[5:10] ELSE n END AS id_value
  FROM (SELECT '{_H}' || p_partkey AS hub_uri, p_size, lpad(p_partkey::VARCHAR, 10, '0') AS n FROM part)),
g_relation AS (SELECT DISTINCT relation_id, '{_H}' || l_partkey AS source_uri, CASE WHEN l_orderkey % 41 = 0 THEN 'http://{_C.host}/resources/works/' ELSE '{_H}' END || b_part AS target_uri FROM e),
g_relation_type AS (SELECT DISTINCT relation_id, CASE WHEN l_returnflag = 'N' AND l_suppkey % 20 = 3 THEN 'bnode://' || relation_id
    ELSE CASE WHEN l_linestatus = 'O' THEN '{_VOC}' ELSE '{_ENT}' END || ([{_SLUGS}])[CAST(floor(l_quantity * l_quantity / 108) AS INT) + 1] END AS type_uri
  FROM e WHERE l_suppkey % 17 <> 0
  UNION SELECT relation_id, '{_VOC}relatedwork' FROM e WHERE l_suppkey % 17 <> 0 AND l_quantity % 9 = 0),
typed AS (SELECT r.source_uri, r.target_uri, coalesce(replace(replace(t.type_uri, '{_VOC}', ''), '{_ENT}', ''), 'related') AS rel_type
  FROM g_relation r LEFT JOIN g_relation_type t ON r.relation_id = t.relation_id
  WHERE r.source_uri IN (SELECT hub_uri FROM g_hub) AND r.target_uri IN (SELECT hub_uri FROM g_hub) AND (t.type_uri IS NULL OR NOT starts_with(t.type_uri, 'bnode'))),
nb AS (SELECT source_uri, target_uri, rel_type, false AS is_direct, false AS is_inbound FROM typed
  UNION ALL SELECT target_uri, source_uri, rel_type || '_INBOUND', false, true FROM typed),
one AS (SELECT source_uri, target_uri, rel_type, is_direct, is_inbound FROM (
  SELECT *, row_number() OVER (PARTITION BY source_uri, target_uri ORDER BY starts_with(rel_type, 'related'), is_inbound, rel_type) AS rn FROM nb) WHERE rn = 1),
freq AS (SELECT replace(replace(type_uri, '{_VOC}', ''), '{_ENT}', '') AS rel_type, count(*) AS freq FROM g_relation_type WHERE NOT starts_with(type_uri, 'bnode') GROUP BY 1),
deg AS (SELECT h.hub_uri, coalesce(o.n, 0) AS out_rels, coalesce(i.n, 0) AS in_rels FROM g_hub h
  LEFT JOIN (SELECT source_uri, count(*) AS n FROM g_relation WHERE target_uri IN (SELECT hub_uri FROM g_hub) GROUP BY 1) o ON h.hub_uri = o.source_uri
  LEFT JOIN (SELECT target_uri, count(*) AS n FROM g_relation WHERE source_uri IN (SELECT hub_uri FROM g_hub) GROUP BY 1) i ON h.hub_uri = i.target_uri),
ctx AS (SELECT h.hub_uri, t.title, coalesce(a.agents, []) AS agents, coalesce(m.media, []) AS media FROM g_hub h
  LEFT JOIN (SELECT hub_uri, min(main_titles[1]) AS title FROM g_title GROUP BY 1) t ON h.hub_uri = t.hub_uri
  LEFT JOIN (SELECT hub_uri, list_sort(list(DISTINCT agent_uri)) AS agents FROM g_agent GROUP BY 1) a ON h.hub_uri = a.hub_uri
  LEFT JOIN (SELECT hub_uri, list_sort(list(DISTINCT type_uri)) AS media FROM g_type GROUP BY 1) m ON h.hub_uri = m.hub_uri)"""

_TIER = "CASE " + " ".join(f"WHEN {{s}} IN ({', '.join(repr(x) for x, own in TIER_OF.items() if own == t)}) THEN {t}" for t in BASES) + " ELSE 3 END"
_BASE = "CASE {t} " + " ".join(f"WHEN {t} THEN {float(b)}::DOUBLE" for t, b in BASES.items()) + " END"
_LABELS = ", ".join(f"('{s}', '{x}')" for s, x in sorted(LABEL_OF.items()))


def tier(s: str) -> str:
    return _TIER.format(s=f"lower({s})")


def clean(s: str) -> str:
    return f"lower(replace({s}, '_INBOUND', ''))"


LABEL_TABLE = f"lbl AS (SELECT * FROM (VALUES {_LABELS}) v(slug, label))"


def made_label(bare: str) -> str:
    short = f"regexp_replace({bare}, '(of|for)$', '')"
    return f"upper({short}[1]) || {short}[2:]"


def label(s: str) -> str:
    bare = f"regexp_replace({clean(s)}, '^ns[0-9]+__', '')"
    return f"coalesce((SELECT label FROM (VALUES {_LABELS}) v(slug, label) WHERE slug = {bare}), {made_label(bare)})"


def author(s: str, t: str) -> str:
    both = f"len(list_intersect({s}, {t}))"
    return f"CASE WHEN len({s}) = 0 OR len({t}) = 0 THEN 5.0 WHEN {both} = 0 THEN 15.0 WHEN {both} < greatest(len({s}), len({t})) THEN 8.0 ELSE 0.0 END::DOUBLE"


def specific(m: str) -> str:
    return f"list_filter({m}, lambda x: x NOT IN ('{_BF}Hub', '{_BF}Work'))"


def medium(s: str, t: str) -> str:
    return f"CASE WHEN len({s}) > 0 AND len({t}) > 0 AND len(list_intersect({s}, {t})) = 0 THEN 10.0 WHEN len({s}) = 0 AND len({t}) > 0 THEN 8.0 WHEN len({s}) > 0 AND len({t}) = 0 THEN 3.0 ELSE 0.0 END::DOUBLE"


def rarity(f: str, m: str) -> str:
    return f"CASE WHEN {f} > 0 AND {m} > 0 THEN 10.0::DOUBLE * (1.0::DOUBLE - log10({f}::DOUBLE + 1.0) / log10({m}::DOUBLE + 1.0)) ELSE 5.0::DOUBLE END"


SCORED = f"""{GRAPH},
mx AS (SELECT coalesce(max(freq), 1) AS max_freq FROM freq),
j AS (SELECT one.*, {clean('one.rel_type')} AS slug, coalesce(f.freq, 0) AS freq, mx.max_freq, s.agents AS sa, t.agents AS ta, t.title, {specific('s.media')} AS sm, {specific('t.media')} AS tm
  FROM one CROSS JOIN mx LEFT JOIN freq f ON {clean('one.rel_type')} = f.rel_type LEFT JOIN ctx s ON one.source_uri = s.hub_uri LEFT JOIN ctx t ON one.target_uri = t.hub_uri),
k AS (SELECT j.*, {tier('slug')} AS tier, {rarity('freq', 'max_freq')} AS rarity_bonus, {author('sa', 'ta')} AS author_bonus, {medium('sm', 'tm')} AS medium_bonus FROM j),
l AS (SELECT k.*, {_BASE.format(t='tier')} AS base FROM k),
scored AS (SELECT l.*, least(100.0::DOUBLE, greatest(0.0::DOUBLE, base + rarity_bonus + author_bonus + medium_bonus)) AS score,
  (len(sa) > 0 AND len(ta) > 0 AND len(list_intersect(sa, ta)) = 0) AS different_author, list_transform(tm, lambda x: regexp_extract(x, '[^/]+$')) AS media FROM l),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY round(score, 9) DESC, target_uri) AS rank FROM scored)"""
