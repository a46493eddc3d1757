"""Repair of drifted JSON payloads, by schema.

Payload lists hold values of mixed kinds, which no fixed struct describes, so a repair runs on Arrow batches as one
pandas UDF from (schema, payload) to the repaired JSON text. Rules are plain functions in RULES; more may be registered.
Null and unreadable payloads repair to the schema's empty form; a schema without a rule gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Names under which payloads carry their lists, in the order they are tried.
DUPLICATE_NAMES = ["duplicate_facts", "duplicate_indices", "duplicates", "dup_idx", "duplicate_fact_ids", "duplicate_ids"]
CONTRADICTED_NAMES = ["contradicted_facts", "contradicted_indices", "contradictions", "contra_idx", "contradicted_fact_ids", "contradicted_ids"]
EDGE_NAMES = ["facts", "fact_triples", "edges_list", "relations"]
RESOLUTION_NAMES = ["resolutions", "dedupe_results", "nodes", "node_resolutions"]
ENTITY_NAMES = ["extracted_entities", "entities", "node_list", "extracted", "items"]
SUMMARY_NAMES = ["summaries", "summarized_entities", "summary_list", "items"]
CLASS_NAMES = ["SummarizedEntity", "ExtractedEntity", "SummarizedEntities", "ExtractedEntities"]
ENTITY_MARKS = ["name", "summary", "entity_type", "entity_type_id"]
NULL_WORDS = ["none", "null", "empty", "n/a", "no", "false"]
UNNAMED = "<unnamed>"


class Rule(NamedTuple):
    """Schemas a rule serves, its priority (lowest first) and the repair."""

    name: str
    schemas: tuple[str, ...]
    priority: int
    repair: Callable[[str, Any], dict]


def _int_of(value: Any) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def ints_of(value: Any) -> list[int]:
    """Whole numbers of a number, a list, or a text of numbers between commas or semicolons; what is none is left out."""
    if isinstance(value, str):
        bare = re.sub(r"^[\s\[\](){}\"']+|[\s\[\](){}\"']+$", "", value)
        value = [] if bare.lower() in NULL_WORDS else re.split("[,;]", bare)
    elif not isinstance(value, list):
        value = [value]
    return [n for n in map(_int_of, value) if n is not None]


def unwrapped(payload: dict) -> dict:
    """The payload with an object under 'properties' spread out; what stands beside it wins."""
    inner = payload.get("properties")
    return inner | {k: v for k, v in payload.items() if k != "properties"} if isinstance(inner, dict) else payload


def _first_of(payload: dict, names: list[str]) -> str | None:
    return next((n for n in names if n in payload), None)


def edge_duplicates(_: str, payload: Any) -> dict:
    """Both lists, always there, as whole numbers."""
    own = unwrapped(payload) if isinstance(payload, dict) else {}
    pick = lambda names: ints_of(own.get(_first_of(own, names) or ""))
    return {"duplicate_facts": pick(DUPLICATE_NAMES), "contradicted_facts": pick(CONTRADICTED_NAMES)}


def _listed(payload: Any, key: str, names: list[str]) -> dict | None:
    """A list under its key; from another name the payload's other keys stay."""
    if isinstance(payload, list):
        return {key: payload}
    if not isinstance(payload, dict):
        return {key: []}
    own = unwrapped(payload)
    as_list = lambda v: v if isinstance(v, list) else []
    if key in own:
        return {key: as_list(own[key])}
    if other := _first_of(own, names):
        return {key: as_list(own[other])} | {k: v for k, v in own.items() if k != other}
    return None


def extracted_edges(_: str, payload: Any) -> dict:
    """The list of edges."""
    return _listed(payload, "edges", EDGE_NAMES) or {"edges": []}


def node_resolutions(_: str, payload: Any) -> dict:
    """The list of resolutions; a lone one is put in a list."""
    if (found := _listed(payload, "entity_resolutions", RESOLUTION_NAMES)) is not None:
        return found
    own = unwrapped(payload)
    return {"entity_resolutions": [own] if "id" in own and "name" in own else []}


def extracted_entity(entity: Any) -> dict:
    """An entity with a name, a type number and episode numbers; truth values are no numbers."""
    if not isinstance(entity, dict):
        return {"name": str(entity), "entity_type_id": 0, "episode_indices": [0]}
    kind, at = entity.get("entity_type_id"), entity.get("episode_indices", [0])
    kind = 0 if isinstance(kind, bool) else _int_of(kind) or 0
    numbers = ints_of(at) if isinstance(at, list) else [] if isinstance(at, bool) else [n for n in [_int_of(at)] if n is not None]
    return entity | {"entity_type_id": kind, "episode_indices": numbers or [0], "name": entity.get("name") or UNNAMED}


def summarized_entity(entity: Any) -> dict:
    """An entity with a name and a summary; anything that is no object is the summary."""
    if not isinstance(entity, dict):
        return {"name": UNNAMED, "summary": "" if entity is None else str(entity)}
    return entity | {"name": entity.get("name") or UNNAMED, "summary": entity.get("summary") or ""}


def _entity_list(payload: Any, names: list[str]) -> list:
    """The entities of a payload (or of the JSON that it is as a text): a list, what a known name holds, or else the payload if it looks like an entity."""
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except ValueError:
            return []
    if not isinstance(payload, dict):
        return payload if isinstance(payload, list) else []
    own = unwrapped(payload)
    places = [(n, (list, dict)) for n in names] + [(n, (list, dict, str)) for n in CLASS_NAMES]
    held = [own[n] for n, kinds in places if isinstance(own.get(n), kinds)] or ([own] if own.keys() & set(ENTITY_MARKS) else [[]])
    return held[0] if isinstance(held[0], list) else [held[0]]


def entities(schema: str, payload: Any) -> dict:
    """The list of extracted or summarized entities, each made whole."""
    if schema == "SummarizedEntities":
        return {"summaries": [summarized_entity(e) for e in _entity_list(payload, SUMMARY_NAMES)]}
    return {"extracted_entities": [extracted_entity(e) for e in _entity_list(payload, ENTITY_NAMES)]}


#: Rules by priority.
RULES = [
    Rule("edge_duplicate", ("EdgeDuplicate",), 10, edge_duplicates),
    Rule("extracted_edges", ("ExtractedEdges",), 20, extracted_edges),
    Rule("extracted_entities", ("ExtractedEntities", "SummarizedEntities"), 30, entities),
    Rule("node_resolutions", ("NodeResolutions", "EntityResolutions"), 40, node_resolutions),
]


def rule_for(schema: str, rules: list[Rule] = RULES) -> Rule | None:
    """The rule of the lowest priority number that serves a schema."""
    return min((r for r in rules if schema in r.schemas), key=lambda r: r.priority, default=None)


def repair_json(schema: str | None, payload: str | None, rules: list[Rule] = RULES) -> str | None:
    """The repaired payload as JSON text; null without a rule."""
    rule = rule_for(schema or "", rules)
    if rule is None:
        return None
    try:
        value = json.loads(payload) if payload is not None else None
    except ValueError:
        value = payload
    return json.dumps(rule.repair(schema or "", value), separators=(",", ":"), ensure_ascii=False)


def repaired(schema: Column, payload: Column) -> Column:
    """The repaired payload, on Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for schemas, payloads in batches:
            yield pd.Series([repair_json(s, p) for s, p in zip(schemas, payloads)], dtype=object)

    return run(schema, payload)


def with_repairs(rows: DataFrame, schema: str = "schema_name", payload: str = "payload_json") -> DataFrame:
    """Rows with repaired_json, rule and state: 'kept' if nothing changed, 'repaired', or 'unrepairable'."""
    names = F.create_map(*[F.lit(x) for r in RULES for s in r.schemas for x in (s, r.name)])
    out = rows.withColumn("repaired_json", repaired(F.col(schema), F.col(payload))).withColumn("rule", F.try_element_at(names, F.col(schema)))
    same = F.try_parse_json("repaired_json").cast("string") == F.try_parse_json(payload).cast("string")
    return out.withColumn("state", F.when(F.col("repaired_json").isNull(), "unrepairable").when(F.coalesce(same, F.lit(False)), "kept").otherwise("repaired"))


def append_quirks(repairs: DataFrame, path: str, now: str, schema: str = "schema_name", payload: str = "payload_json") -> None:
    """Appends a JSON line for each repaired row of ``with_repairs``: when, by which rule, and the payload before and after."""
    changed = repairs.where("state = 'repaired'")
    changed.select(F.lit(now).alias("at"), "rule", F.col(schema).alias("schema"), F.col(payload).alias("before"), F.col("repaired_json").alias("after")).write.mode("append").json(path)
