"""Traversal search and catalogue on the trade graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.operators.catalog import blocked_keyword, get_entity, list_entities
from loomgraph.operators.traverse import SCORED_FACTS, TRAIL_ORDER, found_facts, rerank, scored, search_request, seeds_found, trails
from loomgraph.plans.staging import staged
from loomgraph.operators.consolidation_queries import _W
from loomgraph.sources.graph import TRADE_SQL, Graph, memory_graph, trade_graph
from loomgraph.streaming.ingest import over_rate
from loomgraph.sources.tables import table

#: Seeds of the queries; the last one names no node.
SEEDS = ["Supplier#000000001", "NATION_3", "nobody"]


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _vectors(graph: Graph, facts: DataFrame) -> DataFrame:
    """Vectors of the facts at hand: an edge's number picks one of the stored vectors."""
    many = graph.vectors.count()
    numbers = facts.select("eid").distinct().withColumn("number", F.aggregate(F.regexp_extract_all("eid", F.lit(r"\d+"), F.lit(0)), F.lit(7).cast("long"), lambda s, x: F.pmod(s * 31 + x.cast("long"), F.lit(max(many, 1)))))
    return numbers.join(graph.vectors, "number").select("eid", "fact_embedding")


def _shown(rows: DataFrame) -> DataFrame:
    extra = [F.round(c, 5).alias(c) for c in ("cosine", "score") if c in rows.columns]
    return rows.select("fact", "source", "target", "edge_type", "hop", F.array_join("path", " > ").alias("path"), "trail", "place", *extra)


def g2_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trails of up to two edges from the seeds, counted by seed and hop."""
    found = trails(trade_graph(spark, sf_dir), SEEDS, 2)
    return found.select(F.get("names", F.lit(0)).alias("seed"), F.size("steps").alias("hop")).groupBy("seed", "hop").agg(F.count(F.lit(1)).alias("trails"))


def g7_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a two-hop traversal, capped after ordering."""
    return _shown(found_facts(trade_graph(spark, sf_dir), SEEDS, 2))


def _mention_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, str]:
    """Entities and episodes tied by mentions, and the name of the most mentioned entity."""
    memory = memory_graph(spark, sf_dir)
    nodes = staged(memory.entity.select("uuid", "name", "summary").unionByName(memory.episodic.select("uuid", "name", F.col("content").alias("summary"))), "nodes")
    edges = staged(memory.mentions.select(F.col("uuid").alias("eid"), F.col("src_uuid").alias("src"), F.col("dst_uuid").alias("dst"), F.lit("MENTIONS").alias("edge_type"), F.lit(None).cast("string").alias("fact"), F.lit(None).cast("timestamp").alias("invalid_at")), "edges")
    often = edges.groupBy(F.col("dst").alias("uuid")).agg(F.count(F.lit(1)).alias("n")).join(memory.entity.where("name is not null").select("uuid", "name"), "uuid")
    first = often.orderBy(F.col("n").desc(), "uuid").first()
    return Graph(nodes, edges), first["name"] if first else ""


def g2_mention_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails of up to two mentions from the most mentioned name, counted by hop and the name at their end."""
    graph, seed = _mention_graph(spark, sf_dir)
    found = trails(graph, [seed], 2)
    return found.select(F.size("steps").alias("hop"), F.element_at("names", -1).alias("target")).groupBy("hop", "target").agg(F.count(F.lit(1)).alias("trails"))


def t5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whether their user had more than two in the hour up to them."""
    over = over_rate(table(spark, sf_dir, "events"), "user_id", "ts", 3600, 2)
    return over.groupBy("user_id").agg(F.count_if("over").alias("too_many"), F.count(F.lit(1)).alias("n"))


def g3_live_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop over live edges only."""
    return _shown(found_facts(trade_graph(spark, sf_dir), SEEDS, 1, live_only=True))


def g10_typed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop over edges of one type."""
    return _shown(found_facts(trade_graph(spark, sf_dir), SEEDS, 1, edge_types=["RELATES_TO"]))


def _search(lam: float, min_cosine: float | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = trade_graph(spark, sf_dir)
        request = search_request(SEEDS, 2, min_cosine, lam, 20)
        facts = found_facts(graph, request.seeds, request.max_hops)
        trimmed = staged(facts.orderBy(*TRAIL_ORDER).limit(SCORED_FACTS), "first")  # read for their vectors and for their scores
        return _shown(rerank(scored(trimmed, _vectors(graph, trimmed), _query_vector(spark, sf_dir)), request.rerank_lambda, request.limit, request.min_cosine))

    run.__doc__ = f"Traversal search with lambda {lam} and cosine floor {min_cosine}."
    return run


def s7_seed_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds that exist."""
    return seeds_found(trade_graph(spark, sf_dir), SEEDS)


def g12_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a scored row lacks its cosine, and whether a cap was reached."""
    graph = trade_graph(spark, sf_dir)
    facts = staged(found_facts(graph, SEEDS, 2), "facts")
    rows = scored(facts, _vectors(graph, facts), _query_vector(spark, sf_dir))
    count = facts.agg(F.count(F.lit(1)).alias("facts"))
    flags = rows.agg(F.count(F.lit(1)).alias("scored"), F.coalesce(F.bool_or(F.col("cosine").isNull()), F.lit(False)).alias("degraded"))
    return flags.join(F.broadcast(count)).withColumn("capped", F.col("facts") >= 5000)  # one row each


def g13_get_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood of the names that contain a text."""
    return get_entity(trade_graph(spark, sf_dir), "nation_1").select("name", F.array_join("relations", "; ").alias("relations"))


def g14_list_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of most edges."""
    return list_entities(trade_graph(spark, sf_dir))


def g14_list_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of most edges."""
    return list_entities(trade_graph(spark, sf_dir), "SUPPLIER", 30)


def pred14_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and the keyword that blocks them."""
    asked = ["SELECT * FROM nodes", "select 1; drop table nodes", "WITH x AS (SELECT 'please delete me' t) SELECT t FROM x", "SELECT created, settings FROM nodes", "MATCH (n) SET n.x = 1"]
    return spark.createDataFrame([(s, blocked_keyword(s)) for s in asked], "statement string, blocked string")


QUERIES = {
    "g2_trails": g2_trails, "g2_mention_trails": g2_mention_trails, "t5_rates": t5_rates, "g3_live_facts": g3_live_facts, "g7_facts": g7_facts, "g10_typed_facts": g10_typed_facts, "g12_degraded": g12_degraded, "g13_get_entity": g13_get_entity, "g14_list_entities": g14_list_entities, "g14_list_suppliers": g14_list_suppliers,
    "v3_search_mixed": _search(0.7), "v4_search_by_hop": _search(0.0), "v5_search_by_cosine": _search(1.0), "pred10_search_floor": _search(0.7, 0.1), "s7_seed_probe": s7_seed_probe, "pred14_read_only": pred14_read_only,
}

_IN = "(" + ", ".join(f"'{s}'" for s in SEEDS) + ")"


def _trails_sql(edge_filter: str = "true", hops: int = 2) -> str:
    two = """
  UNION ALL SELECT [s.name, n1.name, n2.name], [h1.eid, h2.eid], [h1.edge_type, h2.edge_type], [coalesce(nullif(h1.fact, ''), nullif(n1.summary, '')), coalesce(nullif(h2.fact, ''), nullif(n2.summary, ''))]
  FROM seeds s JOIN half h1 ON h1.a = s.uuid JOIN nodes n1 ON n1.uuid = h1.b JOIN half h2 ON h2.a = h1.b AND h2.eid <> h1.eid JOIN nodes n2 ON n2.uuid = h2.b"""
    return f"""WITH {TRADE_SQL},
half AS (SELECT src a, dst b, eid, edge_type, fact FROM edges WHERE {edge_filter} UNION ALL SELECT dst, src, eid, edge_type, fact FROM edges WHERE src <> dst AND {edge_filter}),
seeds AS (SELECT * FROM nodes WHERE name IN {_IN}),
trails AS (
  SELECT [s.name, n1.name] nm, [h1.eid] es, [h1.edge_type] ts, [coalesce(nullif(h1.fact, ''), nullif(n1.summary, ''))] fs FROM seeds s JOIN half h1 ON h1.a = s.uuid JOIN nodes n1 ON n1.uuid = h1.b {two if hops == 2 else ''}),
un AS (SELECT *, unnest(range(len(es))) place FROM trails),
facts AS (
  SELECT trim(fs[place + 1]) fact, nm[1] source, nm[place + 2] target, coalesce(ts[place + 1], 'RELATES_TO') edge_type, CAST(len(es) AS INTEGER) hop, array_to_string(nm[1:place + 1], ' > ') path, array_to_string(es, '|') trail, CAST(place AS INTEGER) place, es[place + 1] eid
  FROM un WHERE fs[place + 1] IS NOT NULL ORDER BY hop, fact, trail, place LIMIT 5000)
"""


_SCORED = """,
first AS (SELECT * FROM facts ORDER BY hop, fact, trail, place LIMIT 200),
num AS (SELECT *, list_reduce(list_prepend(CAST(7 AS BIGINT), list_transform(regexp_extract_all(eid, '\\d+'), lambda x: CAST(x AS BIGINT))), lambda s, x: (s * 31 + x) % many) number FROM first, (SELECT count(*) many FROM embeddings)),
sc AS (SELECT n.*, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) cosine FROM num n LEFT JOIN embeddings e ON e.vec_id = n.number)
"""
_COLS = "fact, source, target, edge_type, hop, path, trail, place"


def _ranked_sql(score: str, order: str, floor: str = "true") -> str:
    return _trails_sql() + _SCORED + f", r AS (SELECT *, {score} score FROM (SELECT *, max(cosine) OVER () mx FROM sc WHERE {floor})) SELECT {_COLS}, round(cosine, 5) cosine, round(score, 5) score FROM r ORDER BY {order}, hop, fact, trail, place LIMIT 20"


_MIX = "round(cosine - (1 - 0.7) * 2 * hop * (mx - cosine + 0.2), 9)"
_ENDS = "ends AS (SELECT eid, coalesce(edge_type, 'RELATES_TO') rel, src uuid, dst other FROM edges UNION ALL SELECT eid, coalesce(edge_type, 'RELATES_TO'), dst, src FROM edges WHERE src <> dst)"
_LIST = "SELECT name, CAST(count(e.eid) AS BIGINT) degree FROM nodes n LEFT JOIN ends e ON e.uuid = n.uuid {0} GROUP BY name ORDER BY degree DESC, name LIMIT {1}"
ORACLES = {
    "g2_trails": _trails_sql() + "SELECT nm[1] seed, CAST(len(es) AS INTEGER) hop, count(*) trails FROM trails GROUP BY 1, 2",
    "g2_mention_trails": _W + """, nn AS (SELECT uuid, name FROM en UNION ALL SELECT uuid, name FROM ep), hf AS (SELECT src_uuid a, dst_uuid b, uuid eid FROM me UNION ALL SELECT dst_uuid, src_uuid, uuid FROM me WHERE src_uuid <> dst_uuid),
sd AS (SELECT name FROM (SELECT dst_uuid, count(*) n FROM me GROUP BY 1) JOIN en ON en.uuid = dst_uuid WHERE name IS NOT NULL ORDER BY n DESC, dst_uuid LIMIT 1), st AS (SELECT uuid FROM nn WHERE name = (SELECT name FROM sd)),
o1 AS (SELECT x.b, x.eid, n.name FROM st JOIN hf x ON x.a = st.uuid JOIN nn n ON n.uuid = x.b)
SELECT 1 hop, name target, count(*) trails FROM o1 GROUP BY name UNION ALL SELECT 2, n.name, count(*) FROM o1 JOIN hf y ON y.a = o1.b AND y.eid <> o1.eid JOIN nn n ON n.uuid = y.b GROUP BY n.name""",
    "t5_rates": "SELECT user_id, count(*) FILTER (c > 2) too_many, count(*) n FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)::BIGINT // 1000000 RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) c FROM events) GROUP BY 1",
    "g3_live_facts": _trails_sql("invalid_at IS NULL", 1) + f"SELECT {_COLS} FROM facts",
    "g7_facts": _trails_sql() + f"SELECT {_COLS} FROM facts",
    "g10_typed_facts": _trails_sql("coalesce(edge_type, 'RELATES_TO') = 'RELATES_TO'", 1) + f"SELECT {_COLS} FROM facts",
    "g12_degraded": _trails_sql() + _SCORED + "SELECT count(*) scored, coalesce(bool_or(cosine IS NULL), false) degraded, (SELECT count(*) FROM facts) facts, (SELECT count(*) FROM facts) >= 5000 capped FROM sc",
    "g13_get_entity": f"WITH {TRADE_SQL}, {_ENDS} SELECT n.name, array_to_string(list_sort(list(DISTINCT e.rel || ' ' || o.name)), '; ') relations FROM nodes n LEFT JOIN ends e ON e.uuid = n.uuid LEFT JOIN nodes o ON o.uuid = e.other WHERE contains(lower(n.name), 'nation_1') GROUP BY n.name ORDER BY 1 LIMIT 50",
    "g14_list_entities": f"WITH {TRADE_SQL}, {_ENDS} " + _LIST.format("", 20),
    "g14_list_suppliers": f"WITH {TRADE_SQL}, {_ENDS} " + _LIST.format("WHERE contains(lower(name), 'supplier')", 30),
    "v3_search_mixed": _ranked_sql(_MIX, "score DESC"), "v4_search_by_hop": _ranked_sql("cosine", "hop, score DESC"), "v5_search_by_cosine": _ranked_sql("cosine", "score DESC"), "pred10_search_floor": _ranked_sql(_MIX, "score DESC", "cosine >= 0.1"),
    "s7_seed_probe": f"WITH {TRADE_SQL} SELECT DISTINCT name seed FROM nodes WHERE name IN {_IN}",
    "pred14_read_only": "SELECT * FROM (VALUES ('SELECT * FROM nodes', NULL), ('select 1; drop table nodes', 'DROP'), ('WITH x AS (SELECT ''please delete me'' t) SELECT t FROM x', 'DELETE'), ('SELECT created, settings FROM nodes', NULL), ('MATCH (n) SET n.x = 1', 'SET')) v(statement, blocked)",
}
