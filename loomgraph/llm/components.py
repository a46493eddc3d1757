"""Pairwise matches consolidated into groups.

The graph of pairs is reduced until nothing of degree one or two is left to take: vertices of degree one are
stripped onto their neighbour, and chains of degree-two vertices are compressed by list ranking (pointer doubling
along both directions of the chain) onto the chain's ends. A degree-two vertex below both its neighbours stays as an
end, so that rings have ends as well. What remains, the core, is solved by hooking each vertex to its lowest
neighbour, jumping to the roots and contracting. Each step only writes down "vertex -> vertex that stands for it";
the labels of all removed vertices are restored from these links by pointer jumping, and each group is named by its
lowest member.

Steps that meet at a vertex of any degree are aggregations (combined before the shuffle) or joins on edges, which are
unique; the few joins on a vertex that may be frequent go through spread_join. Every round is written to the shared
folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.plans.skew import spread_join
from loomgraph.plans.staging import staged

_LINK = ["v", "u"]


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("h")).select("h.v", "h.u")


def _edge(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _chains(inner: DataFrame) -> DataFrame:
    """For each chain vertex (v, n1, n2: its neighbours) the two ends (v, e1, e2) of its chain, by list ranking."""
    # a list node is (v, prev): standing at v, come from prev; it points to (next, v)
    nodes = inner.select(F.explode(F.array(F.struct("v", F.col("n1").alias("prev"), F.col("n2").alias("at")), F.struct("v", F.col("n2").alias("prev"), F.col("n1").alias("at")))).alias("h")).select("h.v", "h.prev", "h.at", F.col("h.v").alias("at_prev"), F.lit(False).alias("done"))
    ranked = staged(nodes, "chain")
    while True:
        onward = ranked.select(F.col("v").alias("at"), F.col("prev").alias("at_prev"), F.col("at").alias("on"), F.col("at_prev").alias("on_prev"), F.col("done").alias("on_done"))
        moving = ranked.where(~F.col("done")).join(onward, ["at", "at_prev"], "left")
        step = moving.select("v", "prev", F.coalesce("on", "at").alias("at"), F.coalesce("on_prev", "at_prev").alias("at_prev"), (F.col("on").isNull() | F.col("on_done")).alias("done"))
        ranked = staged(ranked.where("done").unionByName(step), "chain")
        if ranked.where(~F.col("done")).isEmpty():
            return ranked.groupBy("v").agg(F.min("at").alias("e1"), F.max("at").alias("e2"))


def _reduce(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """One round of stripping and compressing: the links made and the edges left; None if there was nothing to take."""
    degrees = _both(edges).groupBy("v").agg(F.count(F.lit(1)).alias("degree"), F.min("u").alias("n1"), F.max("u").alias("n2")).where("degree <= 2")
    low = staged(degrees.where((F.col("degree") == 1) | ~((F.col("v") < F.col("n1")) & (F.col("v") < F.col("n2")))), "low")
    inner = low.where("degree = 2").select("v", "n1", "n2")
    # the edges of low vertices, each with who holds it: never more than two rows an edge
    held = low.select("v", "degree", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("u")).select(*_edge(F.col("v"), F.col("u")), "v", "degree")
    taken = staged(held.groupBy("a", "b").agg(F.max("degree").alias("degree"), F.count(F.lit(1)).alias("holders"), F.max("v").alias("v")), "taken")
    if taken.isEmpty():
        return None
    ends = taken.where("degree = 1")  # a lone pair is held by both: its greater vertex goes
    links = ends.select("v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("u"))
    left = edges.join(taken.select("a", "b"), ["a", "b"], "left_anti")
    if not inner.isEmpty():
        chains = staged(_chains(inner), "ends")
        links = links.unionByName(chains.select("v", F.col("e1").alias("u")))
        left = left.unionByName(chains.where("e1 != e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))).distinct()
    return staged(links, "links"), staged(left, "edges")


def _follow(links: DataFrame) -> DataFrame:
    """Links (v, u) of a forest with every v linked to its root, by pointer jumping."""
    while True:
        rows = links.count()
        onward = links.select(F.col("v").alias("u"), F.col("u").alias("on"))
        moved = staged(spread_join(links, onward, "u", "left", rows).select("v", F.coalesce("on", "u").alias("u"), F.col("on").isNotNull().alias("moved")), "links")
        links = moved.select(*_LINK)
        if moved.where("moved").isEmpty():
            return links


def _core(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round on the core: each vertex hooked to its lowest neighbour's root, the edges between the roots left."""
    hooks = _both(edges).groupBy("v").agg(F.min("u").alias("u")).where(F.col("u") < F.col("v"))
    links = _follow(staged(hooks, "hooks"))
    rows = edges.count()
    for side, other in (("a", "b"), ("b", "a")):
        edges = spread_join(edges, links.select(F.col("v").alias(side), F.col("u").alias("root")), side, "left", rows).select(F.coalesce("root", side).alias(side), other)
    return links, staged(edges.where("a != b").select(*_edge(F.col("a"), F.col("b"))).distinct(), "edges")


def groups_of(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(group_key, node_key) for every node named in a pair of two different nodes, the group's lowest node included.

    Rows with a null on either side tie nothing. Pairs repeated, turned round or of a node with itself add nothing;
    a node that only occurs in such a pair isn't listed. An empty input gives an empty result.
    """
    own = pairs.select(F.col(left).alias("x"), F.col(right).alias("y")).where(F.col("x") != F.col("y"))
    edges = staged(own.select(*_edge(F.col("x"), F.col("y"))).distinct(), "edges")
    made: list[DataFrame] = []
    while not edges.isEmpty():
        if (step := _reduce(edges)) is None:
            step = _core(edges)
        links, edges = step
        made.append(links)
    if not made:
        return edges.select(F.col("a").alias("group_key"), F.col("b").alias("node_key"))
    every = made[0]
    for links in made[1:]:
        every = every.unionByName(links)
    rooted = _follow(staged(every, "links"))
    members = staged(rooted.unionByName(rooted.select("u", F.col("u").alias("v")).distinct().select("v", "u")), "members")
    lowest = members.groupBy("u").agg(F.min("v").alias("group_key"))
    return spread_join(members, lowest, "u", "inner", members.count()).select("group_key", F.col("v").alias("node_key"))
