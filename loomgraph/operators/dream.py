"""The nightly consolidation as one job: cluster, merge, prune, look at the dead letters; one audit row.

Each phase is isolated: a phase that fails says so in its status and the others go on. Nothing is changed unless
``force`` (or ``apply_merges`` for the merges) is set; prunes see the merged graph.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, functions as F

from loomgraph.operators import cluster as C, dedup as D, prune as P, queue as Q
from loomgraph.plans.staging import staged
from loomgraph.sources.graph import MemoryGraph

AUDIT = "run_id string, started_at string, completed_at string, status string, episodes_evaluated long, phase_1_status string, phase_2_status string, phase_3_status string, phase_4_status string, error_message string, nodes_before long, nodes_after long"


class Dream(NamedTuple):
    """The graph after the run, undo rows of what was merged, and the audit row."""

    graph: MemoryGraph
    undo: DataFrame | None
    audit: DataFrame


def dream(graph: MemoryGraph, dead: DataFrame, run_id: str, now: str, force: bool = False, apply_merges: bool = False, threshold: float = D.THRESHOLD, min_degree: int = 3) -> Dream:
    """A whole run; the audit's status is 'failed' if any phase failed."""
    spark, said, errors = graph.entity.sparkSession, [], []
    state: dict = {"graph": graph, "undo": None, "pruned": 0}
    before = graph.entity.count()

    def cluster() -> str:
        g = state["graph"]
        nodes = g.entity.select(F.col("uuid").alias("node"))
        pairs = g.mentions.select("src_uuid", "dst_uuid")
        both = nodes.unionByName(g.episodic.select(F.col("uuid").alias("node")))
        if nodes.isEmpty():
            return "SKIPPED"
        run = C.communities(both, C.adjacency(pairs, both, "src_uuid", "dst_uuid"), min_degree)
        end = "converged" if run.converged else f"cycle of {run.oscillating} oscillating nodes resolved" if run.resolved else f"NOT converged, {run.oscillating} nodes still changing"
        return f"COMPLETED: {C.community_sizes(run.labels).count()} communities in {run.rounds} rounds, {end}"

    def merge() -> str:
        g = state["graph"]
        merges = staged(D.greedy_merges(g.entity, D.threshold_of(threshold)), "merges")
        n = merges.count()
        if not n or not (force or apply_merges):
            return f"COMPLETED: {n} merges planned"
        undo = staged(D.undo_rows(g.entity, merges, run_id, now), "undo")
        if undo.count() < n:
            raise RuntimeError("fewer undo rows than victims")
        entity, mentions, relations = D.apply_merges(g.entity, g.mentions, merges, relations=g.relations)
        state["undo"], state["graph"] = undo, MemoryGraph(staged(entity, "entity"), g.episodic, staged(mentions, "mentions"), relations)
        return f"COMPLETED: {n} merges"

    def prune() -> str:
        g = state["graph"]
        ends = [g.mentions.select("dst_uuid")] if g.relations is None else [g.mentions.select("dst_uuid"), g.relations.select("src_uuid"), g.relations.select("dst_uuid")]
        used = P.referenced(*ends)
        n = P.orphans(g.entity, used).where("prunable").count()
        if force and n:
            state["graph"] = g._replace(entity=staged(P.pruned(g.entity, used, True), "entity"))
            state["pruned"] = n
        return f"COMPLETED: {n} {'pruned' if force else 'prunable'}"

    def letters() -> str:
        row = Q.breakdown(dead, Q.PERMANENT_CODES).first()
        return f"COMPLETED: {row['open']} open, {row['classified']} permanent"

    def phase(run: Callable[[], str]) -> None:
        try:
            said.append(run())
        except Exception as e:  # the audit tells; the other phases go on
            said.append(f"FAILED: {type(e).__name__}")
            errors.append(str(e)[:500])

    for run in (cluster, merge, prune, letters):
        phase(run)
    status = "failed" if any(s.startswith("FAILED") for s in said) else "completed"
    audit = spark.createDataFrame([Row(run_id, now, now, status, before, *said, errors[0] if errors else None, before, before - state["pruned"])], AUDIT)
    return Dream(state["graph"], state["undo"], audit)
