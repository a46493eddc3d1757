"""Graph tables: nodes and typed, timed fact edges as DataFrames.

A graph is three frames: nodes (uuid, name, summary), edges (eid, src, dst, edge_type, fact, invalid_at) and, for
search, vectors of facts (eid, fact_embedding). ``trade_graph`` reads one from the order tables; ``memory_graph``
reads the project's own entities, episodes and mentions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.plans.skew import spread_join
from loomgraph.sources.tables import latest, table


class Graph(NamedTuple):
    """Nodes, edges, and the vectors of the edges' facts if there are any."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None


class MemoryGraph(NamedTuple):
    """Entities, episodic nodes, the mentions between them and the relations (fact edges) between entities, each row once by its key."""

    entity: DataFrame
    episodic: DataFrame
    mentions: DataFrame
    relations: DataFrame | None = None


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, suppliers, customers and nations; who supplies, lives and is based where, with a vector for each fact."""
    part, supplier, customer, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer", "nation"))
    nodes = (
        part.select(_key("part", "p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("summary"))
        .unionByName(supplier.select(_key("supp", "s_suppkey").alias("uuid"), F.col("s_name").alias("name"), F.lit("").alias("summary")))
        .unionByName(customer.select(_key("cust", "c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("summary")))
        .unionByName(nation.select(_key("nation", "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string")).alias("summary")))
    )
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("last"))
    supplies = sold.select(
        F.concat_ws(":", F.lit("ps"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("eid"), _key("supp", "l_suppkey").alias("src"), _key("part", "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("edge_type"),
        F.when(F.pmod("l_partkey", F.lit(5)) == 0, "").otherwise(F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit(" supplies part "), F.col("l_partkey").cast("string"))).alias("fact"),
        F.when(F.pmod("l_partkey", F.lit(7)) == 0, F.col("last")).alias("invalid_at"),
    )
    lives = customer.select(_key("cn", "c_custkey").alias("eid"), _key("cust", "c_custkey").alias("src"), _key("nation", "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("edge_type"), F.concat(F.col("c_name"), F.lit(" lives in nation "), F.col("c_nationkey").cast("string")).alias("fact"), F.lit(None).cast("timestamp").alias("invalid_at"))
    based = supplier.select(_key("sn", "s_suppkey").alias("eid"), _key("supp", "s_suppkey").alias("src"), _key("nation", "s_nationkey").alias("dst"), F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("string").alias("fact"), F.lit(None).cast("timestamp").alias("invalid_at"))
    edges = supplies.unionByName(lives).unionByName(based)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("number"), F.col("embedding").alias("fact_embedding"))
    return Graph(nodes, edges, vectors)


#: The same graph in SQL, to stand before a query.
TRADE_SQL = """
nodes AS (
  SELECT 'part:' || p_partkey uuid, p_name AS name, p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size summary FROM part
  UNION ALL SELECT 'supp:' || s_suppkey, s_name, '' FROM supplier
  UNION ALL SELECT 'cust:' || c_custkey, c_name, c_mktsegment FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation of region ' || n_regionkey FROM nation),
edges AS (
  SELECT 'ps:' || l_partkey || ':' || l_suppkey eid, 'supp:' || l_suppkey src, 'part:' || l_partkey dst, 'SUPPLIES' edge_type,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'supplier ' || l_suppkey || ' supplies part ' || l_partkey END fact, CASE WHEN l_partkey % 7 = 0 THEN max(l_shipdate) END invalid_at
  FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'cn:' || c_custkey, 'cust:' || c_custkey, 'nation:' || c_nationkey, 'LIVES_IN', c_name || ' lives in nation ' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 'sn:' || s_suppkey, 'supp:' || s_suppkey, 'nation:' || s_nationkey, NULL, NULL, NULL FROM supplier)
"""


def co_mentions(mentions: DataFrame) -> DataFrame:
    """Relations (uuid, src_uuid, dst_uuid, name, fact, created_at, valid_at, group_id, episodes) among what an episode mentions: its lowest entity to each other one.

    A relation has the uuid, time and group of the mention that it comes from. Mentions without an end give none.
    """
    own = mentions.where("src_uuid is not null and dst_uuid is not null")
    first = own.groupBy("src_uuid").agg(F.min("dst_uuid").alias("_first"))
    each = spread_join(own, first, "src_uuid").where(F.col("dst_uuid") != F.col("_first"))
    return each.select("uuid", F.col("_first").alias("src_uuid"), "dst_uuid", F.lit("CO_MENTIONED").alias("name"), F.lit("mentioned together").alias("fact"), "created_at", F.col("created_at").alias("valid_at"), "group_id", F.array("src_uuid").alias("episodes"))


def memory_graph(spark: SparkSession, sf_dir: str, group: str | None = None) -> MemoryGraph:
    """Entities, episodes, mentions and relations: of repeats the latest, rows without a key all.

    ``group`` keeps one group's: a mention goes with its destination's group, a relation with its source's, an entity
    and an episode with their own. An endpoint that is missing falls back to the other one. The payload's content and source are columns of an episode.
    """
    entity = latest(table(spark, sf_dir, "entity").select("uuid", "name", "summary", "created_at", "group_id"), "uuid", "created_at")
    payload = F.try_parse_json("payload_json")
    text = lambda k: F.try_variant_get(payload, f"$.{k}", "string")
    episodes = latest(table(spark, sf_dir, "episodes").select("id", "payload_json", "created_at", "updated_at"), "id", "updated_at")
    episodic = episodes.select(F.col("id").alias("uuid"), text("name").alias("name"), text("content").alias("content"), "created_at", text("source_description").alias("source_description"), text("group_id").alias("group_id"))
    mentions = latest(table(spark, sf_dir, "mentions").select("uuid", F.coalesce("src_uuid", "dst_uuid").alias("src_uuid"), F.coalesce("dst_uuid", "src_uuid").alias("dst_uuid"), "created_at", "group_id"), "uuid", "created_at")
    relations = co_mentions(mentions)
    if group is not None:
        entity, episodic = (f.where(F.col("group_id") == group) for f in (entity, episodic))
        known = entity.select("uuid").where("uuid is not null").distinct()
        mentions = spread_join(mentions, known.withColumnRenamed("uuid", "dst_uuid"), "dst_uuid").select(*mentions.columns)
        relations = spread_join(relations, known.withColumnRenamed("uuid", "src_uuid"), "src_uuid").select(*relations.columns)
    return MemoryGraph(entity, episodic, mentions, relations)
