"""Components and label-propagation communities of an undirected graph, as joins and aggregations per round.

Every round is written to the shared folder, so lineage stays short. Labels are node ids, whose order is the order of ranks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from loomgraph.operators.propagation import follower
from loomgraph.plans.skew import small, spread_join
from loomgraph.plans.staging import staged

#: Rounds of the propagation at most; the search for a repeated state ends most runs long before.
ROUNDS = 1000
#: Votes of a component, both ways, that one task follows; larger components are followed by joins.
WITHIN = 1 << 19


def adjacency(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, neighbour), both ways, each pair once; loops and edges to unknown nodes are left out. nodes: (node)."""
    pairs = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.col(dst).alias("neighbour")), F.struct(F.col(dst).alias("node"), F.col(src).alias("neighbour")))).alias("p")).select("p.node", "p.neighbour")
    known = nodes.select("node").distinct()
    return pairs.where("node != neighbour").distinct().join(known, "node", "left_semi").join(known.withColumnRenamed("node", "neighbour"), "neighbour", "left_semi").select("node", "neighbour")


def degrees(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(node, degree) of all nodes."""
    return nodes.join(near.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def components(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(node, component): the component's lowest node.

    A round takes the lowest label among the neighbours, hands the lowest that any member saw to the label's own node, and
    jumps to the label's label, so rounds grow with the logarithm of a component's diameter.
    """
    near = staged(near, "near")
    rows = near.count()
    state = before = staged(nodes.select("node", F.col("node").alias("component")), "components")
    hooked_before = None
    while True:
        offered = spread_join(near.select("node", F.col("neighbour").alias("from")), state.select(F.col("node").alias("from"), F.col("component").alias("seen")), "from", "inner", rows).groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = state.join(offered, "node", "left").select("node", "component", F.least("component", F.coalesce("seen", "component")).alias("next"))
        hooked = staged(hooked, "hooked", hooked_before)
        hooked_before = hooked
        pulled = hooked.groupBy("component").agg(F.min("next").alias("pull")).withColumnRenamed("component", "node")
        jump = hooked.join(pulled, "node", "left").select(F.col("node").alias("next"), F.least("next", F.coalesce("pull", "next")).alias("far"))
        new = staged(spread_join(hooked, jump, "next", "left", rows).select("node", F.coalesce("far", "next").alias("component"), (F.coalesce("far", "next") != F.col("component")).alias("moved")), "components", before)
        state, before = new.select("node", "component"), new
        if new.where("moved").isEmpty():
            return state


def component_sizes(parts: DataFrame) -> DataFrame:
    """(component, members), largest first, then the lowest member."""
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("members")).orderBy(F.col("members").desc(), "component")


class Communities(NamedTuple):
    """Labels (node, label), and what the run was like; resolved: a state came back and its oscillating nodes were given one label in each component."""

    labels: DataFrame
    rounds: int
    converged: bool
    oscillating: int
    pinned: int
    resolved: bool = False


def _fingerprint(labels: DataFrame) -> tuple:
    h = F.xxhash64("node", "label")
    return tuple(labels.agg(F.bit_xor(h), F.bit_xor(F.xxhash64(F.lit(1), "label", "node")), F.count(F.lit(1))).first())


def _round(voters: DataFrame, labels: DataFrame, before: DataFrame, rows: int) -> DataFrame:
    """(node, before, label) after a round."""
    told = spread_join(voters, labels.select(F.col("node").alias("neighbour"), "label"), "neighbour", "inner", rows)
    tally = told.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
    return staged(labels.join(tally, "node", "left").select("node", F.col("label").alias("before"), F.coalesce("best.label", "label").alias("label")), "labels", before)


def _joined(voters: DataFrame, rounds: int) -> tuple[DataFrame, int, int, int]:
    """(node, before, label) after the round whose state was there before, or the last; the round, the first such state and the period (0: none)."""
    rows = voters.count()
    labels = step = staged(voters.select("node", F.col("node").alias("label")).distinct(), "labels")
    seen = {_fingerprint(labels): 0}
    for done in range(1, rounds + 1):
        step = _round(voters, labels, step, rows)
        labels = step.select("node", "label")
        mark = _fingerprint(labels)
        if mark in seen:
            return step, done, seen[mark], done - seen[mark]
        seen[mark] = done
    return step, rounds, 0, 0


def communities(nodes: DataFrame, near: DataFrame, min_degree: int = 3, rounds: int = ROUNDS, parts: DataFrame | None = None, within: int = WITHIN) -> Communities:
    """Synchronous label propagation. parts: the components, if they are known.

    A node of less than min_degree neighbours is pinned to its own label and has no say. Every other takes the most
    frequent label among its neighbours that aren't pinned, the lowest of equals; with no such neighbour it keeps its
    own. It ends when nothing changes, or when a state comes back: then all nodes that changed in the last round take,
    in each component, the label of the lowest of them.

    Components don't touch each other, so each is followed by itself, those of at most ``within`` votes in one task each, until its state ``back`` comes back after
    its ``period`` (1: nothing changes any more). All together are first where they were before at the highest ``back`` plus the periods' least common multiple.
    """
    nodes = staged(nodes.select("node").distinct(), "nodes")
    near = staged(near, "near")
    parts = components(nodes, near) if parts is None else parts
    free = staged(degrees(nodes, near).where(F.col("degree") >= min_degree).select("node"), "free")
    pinned = nodes.count() - free.count()
    voters = near.join(free, "node", "left_semi").join(free.withColumnRenamed("node", "neighbour"), "neighbour", "left_semi")
    voters = staged(voters.join(parts, "node").select("component", "node", "neighbour"), "voters")
    large = staged(voters.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > within).select("component"), "large")
    kind = voters.schema["node"].dataType.simpleString()
    sorted_ = voters.join(small(large), "component", "left_anti").repartition("component").sortWithinPartitions("component", "node", "neighbour")
    one = staged(sorted_.mapInArrow(follower(rounds), f"node {kind}, back long, period long, labels array<{kind}>"), "followed")
    ends = [(r["back"], r["period"]) for r in one.groupBy("period").agg(F.max("back").alias("back")).collect()]  # one row a period
    if hot := not large.isEmpty():
        votes = staged(voters.join(small(large), "component", "left_semi").select("node", "neighbour"), "votes")
        step, at, back, period = _joined(votes, rounds)
        ends.append((back, period))
    done = max((b for b, _ in ends), default=0) + math.lcm(*[p for _, p in ends])
    ended = all(p for _, p in ends) and done <= rounds
    converged = ended and all(p == 1 for _, p in ends)
    done = done if ended else rounds
    place = lambda n: F.when(F.col("period") == 0, F.lit(n - done + 1)).otherwise(F.pmod(F.lit(n) - F.col("back"), F.greatest("period", F.lit(1)))).cast("int")
    moved = one.select("node", F.get("labels", place(done - 1)).alias("before"), F.get("labels", place(done)).alias("label"))
    if hot:
        for _ in range((done - at) % period if period else 0):
            step = _round(votes, step.select("node", "label"), step, votes.count())
        moved = moved.unionByName(step.select("node", "before", "label"))
    moved = staged(moved, "moved")
    labels = staged(nodes.join(moved.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    if converged:
        return Communities(labels, done, True, 0, pinned)
    changed = moved.where("label != before")
    if not ended:
        return Communities(labels, done, False, changed.count(), pinned)
    moving = changed.select("node", "label").join(parts, "node")
    lowest = moving.groupBy("component").agg(F.min_by("label", "node").alias("own"))
    settled = moving.select("node", "component").join(lowest, "component").select("node", "own")
    fixed = staged(labels.join(settled, "node", "left").select("node", F.coalesce("own", "label").alias("label")), "labels")
    return Communities(fixed, done, False, changed.count(), pinned, True)


def community_sizes(labels: DataFrame) -> DataFrame:
    """(label, members) of each community."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))


def partition_hash(labels: DataFrame) -> DataFrame:
    """One row: 16 hexadecimal digits of the partition's SHA-256, whatever the labels are called.

    The groups, as sorted lists of nodes, stand in order, each with its length before it. The text of all groups is
    one value, so this is for partitions whose node ids fit into one, as a fingerprint of a whole partition must.
    """
    groups = labels.groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("members"))
    every = groups.agg(F.array_sort(F.collect_list("members")).alias("g"))
    text = F.array_join(F.transform("g", lambda m: F.concat(F.size(m).cast("string"), F.lit(":"), F.array_join(m, "\x1f"))), "")
    return every.select(F.substring(F.sha2(text, 256), 1, 16).alias("partition_hash"))


def metrics(run: Communities, parts: DataFrame) -> DataFrame:
    """One row on a run: nodes, communities, components, largest of each, and whether a community outgrew its component."""
    sizes = community_sizes(run.labels).agg(F.count(F.lit(1)).alias("communities"), F.coalesce(F.max("members"), F.lit(0)).alias("largest_community"), F.coalesce(F.sum("members"), F.lit(0)).alias("nodes"))
    comps = component_sizes(parts).agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("members"), F.lit(0)).alias("largest_component"))
    both = sizes.join(F.broadcast(comps))  # one row each
    return both.withColumns({"oversized": F.col("largest_community") > F.col("largest_component"), "rounds": F.lit(run.rounds), "converged": F.lit(run.converged), "oscillating": F.lit(run.oscillating).cast("long"), "pinned": F.lit(run.pinned).cast("long")})
