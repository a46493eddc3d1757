"""Graph search: trails from seeds, their facts, and reranking by vector similarity.

Trails are undirected paths that use no edge twice (nodes may recur), grown by one equi-join a hop; the frontier is
the small side, which AQE broadcasts while it is small. A trail of length h gives one row for each of its edges, and
hop is the trail's length for all of them. Facts recur over longer trails; nothing is deduplicated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.text import stripped
from loomgraph.functions.vector import cosine
from loomgraph.plans.staging import staged
from loomgraph.sources.graph import Graph

#: Rows of a traversal, and rows of these that are scored, at most: features of the search.
MAX_FACTS, SCORED_FACTS = 5000, 200
#: Order of the rows of a traversal; all columns after fact only break ties.
TRAIL_ORDER = ["hop", "fact", "trail", "place"]


@dataclass(frozen=True)
class SearchRequest:
    """A validated traversal request."""

    seeds: list[str]
    max_hops: int = 2
    min_cosine: float | None = None
    rerank_lambda: float = 0.7
    limit: int = 20
    live_only: bool = False
    edge_types: list[str] = field(default_factory=list)


def search_request(seeds: list[str], max_hops: object = 2, min_cosine: object = None, rerank_lambda: object = 0.7, limit: object = 20, max_limit: int = 50, **more) -> SearchRequest:
    """A request checked: 1 to 5 seeds that aren't blank, 1 to 3 hops, min_cosine in [0, 1], limit clamped.

    A lambda that isn't a number in [0, 1] becomes 0.7; truth values are no numbers.
    """
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    kept = [s.strip() for s in seeds if isinstance(s, str) and s.strip()]
    if not 1 <= len(kept) <= 5:
        raise ValueError("1 to 5 seeds that aren't blank")
    if not isinstance(max_hops, int) or isinstance(max_hops, bool) or not 1 <= max_hops <= 3:
        raise ValueError("1 to 3 hops")
    if min_cosine is not None and not (number(min_cosine) and 0 <= min_cosine <= 1):
        raise ValueError("min_cosine in [0, 1]")
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        raise ValueError("limit of at least 1")
    lam = float(rerank_lambda) if number(rerank_lambda) and 0 <= rerank_lambda <= 1 else 0.7
    return SearchRequest(kept, max_hops, None if min_cosine is None else float(min_cosine), lam, min(limit, max_limit), **more)


def seeds_found(graph: Graph, seeds: list[str]) -> DataFrame:
    """The seeds that name a node."""
    asked = graph.nodes.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string")
    return asked.join(graph.nodes.select(F.col("name").alias("seed")), "seed", "left_semi")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: (a, b, eid, edge_type, fact)."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.select("eid", "edge_type", "fact", F.explode(F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))).alias("w")).select("w.a", "w.b", "eid", "edge_type", "fact")


STEP = "struct<eid:string,edge_type:string,fact:string>"


def _half_edges(graph: Graph, live_only: bool, edge_types: list[str] | None) -> DataFrame:
    """The edges that a search may take, from both ends."""
    edges = graph.edges
    if live_only:
        edges = edges.where(F.col("invalid_at").isNull())
    if edge_types:
        edges = edges.where(F.coalesce("edge_type", F.lit("RELATES_TO")).isin(edge_types))
    return symmetric(edges)


def _seeded(graph: Graph, seeds: list[str]) -> DataFrame:
    """Trails of no edge: (a, names, steps)."""
    return graph.nodes.where(F.col("name").isin(list(dict.fromkeys(seeds)))).select(F.col("uuid").alias("a"), F.array("name").alias("names"), F.array().cast(f"array<{STEP}>").alias("steps"))


def _grown(at: DataFrame, half: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trails one edge longer, no edge twice. The trails are the small side until hubs have multiplied them, and then hubs are many edges of one node: both meet on the node."""
    onward = at.join(half, "a").where(~F.exists("steps", lambda s: s["eid"] == F.col("eid")))
    named = onward.join(nodes.select(F.col("uuid").alias("b"), F.col("name").alias("b_name"), F.nullif(F.col("summary"), F.lit("")).alias("b_summary")), "b")
    fact = F.coalesce(F.nullif(F.col("fact"), F.lit("")), F.col("b_summary"))
    return named.select(F.col("b").alias("a"), F.concat("names", F.array("b_name")).alias("names"), F.concat("steps", F.array(F.struct("eid", "edge_type", fact.alias("fact")).cast(STEP))).alias("steps"))


def trails(graph: Graph, seeds: list[str], max_hops: int, live_only: bool = False, edge_types: list[str] | None = None) -> DataFrame:
    """All trails of 1 to ``max_hops`` edges from nodes named as a seed: names (array), steps (array of eid, edge_type, fact).

    live_only and edge_types restrict the edges; by default none is left out.
    """
    half, at, found = _half_edges(graph, live_only, edge_types), _seeded(graph, seeds), None
    for _ in range(max_hops):
        at = _grown(at, half, graph.nodes)
        found = at if found is None else found.unionByName(at)
    return found.select("names", "steps")


def found_facts(graph: Graph, seeds: list[str], max_hops: int, live_only: bool = False, edge_types: list[str] | None = None, cap: int = MAX_FACTS) -> DataFrame:
    """The rows of ``trail_facts`` over all trails, found hop by hop: as hop is the first key of their order, the search ends when a hop has filled the cap.

    The frontier of a hop is written once, and only nodes and edges at its ends are read on.
    """
    half, at, found, left = _half_edges(graph, live_only, edge_types), _seeded(graph, seeds), None, cap
    for hop in range(1, max_hops + 1):
        grown = _grown(at, half, graph.nodes)
        if hop == max_hops:
            last = trail_facts(grown, left)
            return last if found is None else found.unionByName(last)
        at = staged(grown, "frontier")
        rows = staged(trail_facts(at, left), "facts")
        found = rows if found is None else found.unionByName(rows)
        left -= rows.count()
        if left <= 0:
            break
    return found


def first_line(text: Column) -> Column:
    """The first line of a text that isn't blank, without outer blanks; null if there is none."""
    lines = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.get(F.filter(F.transform(lines, stripped), lambda x: x != ""), F.lit(0))


def trail_facts(found: DataFrame, cap: int = MAX_FACTS) -> DataFrame:
    """Rows (fact, source, target, edge_type, hop, path, eid, trail, place) in TRAIL_ORDER, at most ``cap``.

    path holds the names before the row's target; a row without a fact is left out.
    """
    rows = found.select("names", F.size("steps").alias("hop"), F.array_join(F.transform("steps", lambda s: s["eid"]), "|").alias("trail"), F.posexplode("steps").alias("place", "s"))
    facts = rows.select(
        first_line(F.col("s.fact")).alias("fact"), F.get("names", F.lit(0)).alias("source"), F.get("names", F.col("place") + 1).alias("target"),
        F.coalesce("s.edge_type", F.lit("RELATES_TO")).alias("edge_type"), "hop", F.slice("names", F.lit(1), F.col("place") + 1).alias("path"), F.col("s.eid").alias("eid"), "trail", "place",
    )
    return facts.where(F.col("fact").isNotNull()).orderBy(*TRAIL_ORDER).limit(cap)


def scored(facts: DataFrame, vectors: DataFrame, query: list[float], trim: int = SCORED_FACTS) -> DataFrame:
    """The first ``trim`` facts with their cosine to ``query``; null where a fact has no vector. vectors: (eid, fact_embedding)."""
    first = facts.orderBy(*TRAIL_ORDER).limit(trim)
    asked = F.array(*[F.lit(float(x)) for x in query])
    return first.join(vectors, "eid", "left").withColumn("cosine", F.when(F.col("fact_embedding").isNotNull(), cosine(F.col("fact_embedding"), asked))).drop("fact_embedding")


def rerank(rows: DataFrame, lam: float, limit: int, min_cosine: float | None = None) -> DataFrame:
    """The best rows with ``score``, equals in TRAIL_ORDER.

    lambda of 1 or more goes by cosine, 0 or less by hop and then cosine; between, the score is the cosine less a cost
    that grows with the hop and the distance to the best cosine.
    """
    if min_cosine is not None:
        rows = rows.where(F.col("cosine") >= min_cosine)
    known = F.coalesce("cosine", F.lit(0.0))
    if lam <= 0:
        return rows.withColumn("score", known).orderBy("hop", F.col("score").desc(), *TRAIL_ORDER).limit(limit)
    if lam >= 1:
        return rows.withColumn("score", known).orderBy(F.col("score").desc(), *TRAIL_ORDER).limit(limit)
    best = F.max(known).over(Window.partitionBy())  # at most SCORED_FACTS rows
    return rows.withColumn("score", F.round(known - (1 - lam) * 2 * F.col("hop") * (best - known + 0.2), 9)).orderBy(F.col("score").desc(), *TRAIL_ORDER).limit(limit)


def search_graph(graph: Graph, vectors: DataFrame, request: SearchRequest, query: list[float]) -> DataFrame:
    """A whole traversal search: trails, facts, scores, floor, order, limit."""
    facts = found_facts(graph, request.seeds, request.max_hops, request.live_only, request.edge_types)
    return rerank(scored(facts, vectors, query), request.rerank_lambda, request.limit, request.min_cosine)
