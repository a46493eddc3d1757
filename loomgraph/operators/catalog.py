"""Entity catalogue: neighbourhood, degree listing, and read-only ad-hoc SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.sources.graph import Graph

# Keywords that a read-only query must not hold, in the order they are looked for.
BLOCKED = ["CREATE", "DELETE", "SET", "DROP", "REMOVE", "MERGE", "DETACH", "FOREACH", "CALL", "LOAD CSV"]


def _ends(graph: Graph) -> DataFrame:
    end = lambda own, other: F.struct(F.col(own).alias("uuid"), F.col(other).alias("other"))
    both = F.array(end("src", "dst"), end("dst", "src"))
    return graph.edges.select("eid", F.coalesce("edge_type", F.lit("RELATES_TO")).alias("rel"), F.explode(F.when(F.col("src") == F.col("dst"), F.array(end("src", "dst"))).otherwise(both)).alias("e")).select("eid", "rel", "e.uuid", "e.other")


def get_entity(graph: Graph, name: str, limit: int = 50) -> DataFrame:
    """Names that contain ``name`` in any letter case, each with its distinct (relation, neighbour name) pairs; equal names merge."""
    hits = graph.nodes.where(F.lower("name").contains(name.lower())).select("uuid", "name")
    others = graph.nodes.select(F.col("uuid").alias("other"), F.col("name").alias("other_name"))
    near = hits.join(_ends(graph), "uuid", "left").join(others, "other", "left")
    return near.groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("rel").isNotNull(), F.concat_ws(" ", "rel", "other_name")))).alias("relations")).orderBy("name").limit(limit)


def list_entities(graph: Graph, contains: str | None = None, limit: int = 20) -> DataFrame:
    """Names by their number of edges, most first; ``contains`` keeps names with that text in any letter case."""
    nodes = graph.nodes if contains is None else graph.nodes.where(F.lower("name").contains(contains.lower()))
    degree = _ends(graph).groupBy("uuid").agg(F.count("eid").alias("n"))
    return nodes.join(degree, "uuid", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("degree")).orderBy(F.col("degree").desc(), "name").limit(limit)


def blocked_keyword(statement: str) -> str | None:
    """The first of BLOCKED that stands in a statement as a word, in any letter case, texts in quotes included."""
    return next((k for k in BLOCKED if re.search(rf"\b{k}\b", statement, re.IGNORECASE)), None)


def _changes(spark: SparkSession, statement: str) -> str | None:
    """The first step of a statement's parsed plan that isn't a query's."""
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    load = lambda name: spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(logical + name)
    refused = [load("Command"), load("ParsedStatement")]
    open_ = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    while open_:
        plan = open_.pop()
        if any(kind.isInstance(plan) for kind in refused):
            return plan.nodeName()
        for part in (plan.children(), plan.innerChildren()):
            open_ += [x for x in (part.apply(i) for i in range(part.size())) if hasattr(x, "nodeName") and load("LogicalPlan").isInstance(x)]
    return None


def read_only_sql(spark: SparkSession, statement: str, args: dict | None = None) -> DataFrame:
    """A query on the session's views; anything that isn't a query is refused before it runs."""
    if word := blocked_keyword(statement):
        raise PermissionError(f"read only: {word} is not allowed")
    if not re.match(r"\s*(SELECT|WITH|VALUES|FROM|TABLE)\b", statement, re.IGNORECASE):
        raise PermissionError("read only: a query is expected")
    if changed := _changes(spark, statement):
        raise PermissionError(f"read only: {changed} is not allowed")
    return spark.sql(statement, args=args or {})
