"""Layers by definition, p4_found against a plain program over the same tables, and the SQL of p3 and p4."""

import json
import random
from collections import Counter, defaultdict
from datetime import UTC, datetime

import duckdb
import pytest

from loomgraph.llm import p3_queries, p4_queries
from loomgraph.llm.p3_queries import p3_found
from loomgraph.llm.p4_queries import p4_found
from loomgraph.llm.survivor import layers, survivors, trust_levels
from tests.conftest import rows_of

KNOWN = {"name", "summary", "entity_type", "uuid", "updated_at", "source_description", "created_at"}


def key(x):
    return "".join(c for c in (x or "").lower() if c.isalnum())


def when(x):
    try:
        t = datetime.fromisoformat(x.strip())
    except (ValueError, AttributeError):
        return None
    return (t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp()


def size(x):
    return sum(c.isalnum() for c in (x or ""))


def snapshot(text):
    try:
        o = json.loads(text)
        o = json.loads(o) if isinstance(o, str) else o
    except (ValueError, TypeError):
        return None
    if not isinstance(o, dict):
        return None
    lower = lambda d: {k.lower(): v for k, v in d.items()}
    if lower(o).keys() & KNOWN:
        return lower(o)
    return next((lower(v) for _, v in sorted(o.items()) if isinstance(v, dict) and lower(v).keys() & KNOWN), None)


def test_against_a_plain_program(spark, small):
    read = lambda t: spark.read.parquet(f"{small}/{t}.parquet").collect()
    trust = {r["source_description"].strip().lower(): r["trust_rank"] for r in read("source_trust")}
    sources, found, want = defaultdict(set), defaultdict(list), set()
    for r in read("dream_entity_undo_log"):
        s, t = key(r["source_node_uuid"]), key(r["target_node_uuid"])
        if not s or not t:
            continue
        sources[t].add(s)
        o = snapshot(r["source_node_snapshot"])
        if o is None:
            continue
        late = when(o.get("updated_at"))
        for field in ("name", "summary", "entity_type"):
            v = o.get(field)
            if isinstance(v, str) and size(v) and v.strip().lower() not in ("n/a", "none", "null", "unknown", "tbd"):
                first = {"name": 0, "summary": -size(v), "entity_type": trust.get((o.get("source_description") or "").strip().lower(), 10**9)}[field]
                found[t, field].append((first, float("inf") if late is None else -late, s))
    want |= {("dream_entity_undo_log", t, f, min(c)[2]) for (t, f), c in found.items() if len(sources[t]) > 1}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in p3_found(spark, small).collect():
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    born = {}
    for r in read("entity"):
        t = when(r["created_at"])
        born[key(r["uuid"])] = min(born.get(key(r["uuid"]), float("inf")), float("inf") if t is None else t)
    text = {r["uuid"]: size(r["summary"]) for r in read("orphan")}
    groups = defaultdict(list)
    for x in list(up):
        groups[top(x)].append(x)
    want |= {("orphan", key(g), "summary", key(min((-text[m], born.get(key(m), float("inf")), m) for m in ms)[2])) for g, ms in groups.items()}
    assert {tuple(r) for r in p4_found(spark, small).collect()} == want and len(want) > 20


def peeled(rows, depth):
    """Layers by definition: rows (completeness, trust, recency, key)."""
    left, out = set(rows), []
    while left and len(out) < depth:
        better = lambda a, b: a[0] >= b[0] and a[1] >= b[1] and (a[2], [-ord(c) for c in a[3]]) > (b[2], [-ord(c) for c in b[3]])
        front = {b for b in left if not any(better(a, b) for a in left)}
        out.append(front)
        left -= front
    return out


@pytest.mark.parametrize("seed", range(3))
def test_layers_match_peeling(spark, seed):
    rng = random.Random(seed)
    groups = {g: [(rng.randrange(4), rng.randrange(3), rng.randrange(5), rng.choice("abcde")) for _ in range(n)] for g, n in (("x", 40), ("y", 1), ("z", 9))}
    df = spark.createDataFrame([(g, *r, r[0] > 0) for g, rows in groups.items() for r in rows], "g string, completeness long, trust int, recency long, key string, filled boolean")
    got = {(r["g"], r["layer"], r["completeness"], r["trust"], r["recency"], r["key"]) for r in layers(df, ["g"], 3).collect()}
    assert got == {(g, n, *r) for g, rows in groups.items() for n, front in enumerate(peeled(rows, 3), 1) for r in front}


def test_a_null_is_filled_from_the_next_layer(spark):
    # completeness of the whole record here: the front has no name
    rows = [("t", "name", 5, 1, 9, "a", False), ("t", "name", 4, 1, 8, "b", True), ("t", "name", 4, 0, 7, "c", True), ("u", "name", 0, 0, 1, "d", False)]
    df = spark.createDataFrame(rows, "g string, field_name string, completeness long, trust int, recency long, key string, filled boolean")
    assert rows_of(survivors(layers(df, ["g", "field_name"], 2), ["g", "field_name"])) == [("t", "name", 2, "b")]


def test_too_many_levels_of_trust_are_refused(spark):
    with pytest.raises(ValueError):
        trust_levels(spark.createDataFrame([(f"s{i}", i) for i in range(200)], "source_description string, trust_rank int"))


@pytest.mark.parametrize("name", ["p3_groups", "p4_found", "p4_fronts"])
def test_query_equals_sql(spark, small, name):
    module = p3_queries if name.startswith("p3") else p4_queries
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in ("orphan", "entity", "dream_entity_undo_log", "source_trust"):
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df, sql = module.QUERIES[name](spark, small), c.sql(module.ORACLES[name])
    at = [sql.columns.index(n) for n in df.columns]
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in sql.fetchall())
