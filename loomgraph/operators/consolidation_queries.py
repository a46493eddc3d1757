"""Consolidation on the project's tables: merges, folds, orphans, components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.text import key_form, words
from loomgraph.operators import cluster as C, dedup as D, prune as P
from loomgraph.plans.staging import staged
from loomgraph.sources.graph import memory_graph
from loomgraph.sources.tables import table

#: The group of the queries on one group.
GROUP = "team_aster"


def d1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each entity's summary."""
    return memory_graph(spark, sf_dir).entity.select("uuid", F.size(words(F.col("summary"))).alias("n_words"))


def d3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equally named entities whose summaries share half of their words or more; of equal word sets the lowest uuid stands for all."""
    sets = D.word_sets(memory_graph(spark, sf_dir).entity).groupBy("name", "h").agg(F.min("uuid").alias("uuid"), F.first("w").alias("w"))
    return D.alike_pairs(sets, 0.5).select("a", "b", F.round("score", 6).alias("score"))


def d4_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of the greedy chain."""
    return D.greedy_merges(memory_graph(spark, sf_dir).entity)


def d6_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the merge plan."""
    graph = memory_graph(spark, sf_dir)
    return D.plan_counters(graph.entity, graph.mentions)


def d6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names held by several entities."""
    return memory_graph(spark, sf_dir).entity.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def d7_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last survivor of each entity merged away, one merge a source: the latest by id."""
    undo = table(spark, sf_dir, "dream_entity_undo_log").select("id", key_form(F.col("source_node_uuid")).alias("victim_uuid"), key_form(F.col("target_node_uuid")).alias("survivor_uuid")).dropna()
    last = undo.groupBy("victim_uuid").agg(F.max_by("survivor_uuid", F.struct("id", "survivor_uuid")).alias("survivor_uuid"))
    return D.roots(last)


def _keyed_relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The relations with ends in key form, and where the undo log's merges send them."""
    keyed = memory_graph(spark, sf_dir).relations.withColumns({c: key_form(F.col(c)) for c in ("src_uuid", "dst_uuid")})
    return keyed, d7_roots(spark, sf_dir)


def s3_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of one group's entities, by source."""
    return memory_graph(spark, sf_dir, GROUP).relations.groupBy("src_uuid").agg(F.count(F.lit(1)).alias("n"))


def s2_group_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of one group's entities, by episode."""
    return memory_graph(spark, sf_dir, GROUP).mentions.groupBy("src_uuid").agg(F.count(F.lit(1)).alias("n"))


def d9_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that the merges make loops."""
    return D.redirected_relations(*_keyed_relations(spark, sf_dir)).where("self_loop").select("uuid", F.col("src_uuid").alias("node"))


def d10_relation_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merges do to relations, counted."""
    return D.relation_counters(*_keyed_relations(spark, sf_dir))


def d12_relations_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after the merges, duplicates kept."""
    return D.apply_relations(*_keyed_relations(spark, sf_dir), drop_duplicates=False).select("uuid", "src_uuid", "dst_uuid", "fact", "created_at")


def d13_extra_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after the merges, one for each pair of ends and fact in the whole table."""
    return D.apply_relations(*_keyed_relations(spark, sf_dir), touched_only=False).select("uuid", "src_uuid", "dst_uuid")


def r4_prune_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying a plan of all orphans named in the orphan table does to the graph."""
    graph = memory_graph(spark, sf_dir)
    return P.prune_counters(table(spark, sf_dir, "orphan"), graph.entity, P.referenced(graph.mentions.select("dst_uuid")))


def d11_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that repeat another's name and content."""
    return D.exact_folds(memory_graph(spark, sf_dir).episodic).select("survivor_uuid", "victim_uuid")


def a11_fold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of equal episodes there are, and their rows."""
    e = memory_graph(spark, sf_dir).episodic
    groups = e.groupBy(F.coalesce("name", F.lit("")), F.sha1(F.coalesce("content", F.lit("")))).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("episodes"))


def d15_fold_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions after the fold, by episode."""
    graph = memory_graph(spark, sf_dir)
    return D.fold_mentions(graph.mentions, D.exact_folds(graph.episodic)).groupBy("src_uuid").agg(F.count(F.lit(1)).alias("n"))


def a9_duplicate_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions beyond the first of each pair."""
    return D.duplicate_edges(memory_graph(spark, sf_dir).mentions, ["src_uuid", "dst_uuid"])


def a10_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that the fold makes double."""
    graph = memory_graph(spark, sf_dir)
    moves = D.exact_folds(graph.episodic).select(F.col("victim_uuid").alias("victim"), F.col("survivor_uuid").alias("root"))
    return D.collisions(D.redirected(graph.mentions, moves, ["src_uuid"]), ["src_uuid", "dst_uuid"])


def r2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that no mention names."""
    graph = memory_graph(spark, sf_dir)
    return P.orphans(graph.entity, P.referenced(graph.mentions.select("dst_uuid")))


def r3_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left after pruning, by group."""
    graph = memory_graph(spark, sf_dir)
    return P.pruned(graph.entity, P.referenced(graph.mentions.select("dst_uuid")), True).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


def _merge_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and neighbours of the merges in the undo log."""
    edges = table(spark, sf_dir, "dream_entity_undo_log").select(key_form(F.col("source_node_uuid")).alias("src"), key_form(F.col("target_node_uuid")).alias("dst")).dropna()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes, C.adjacency(edges, nodes)


def g16_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each node of the merge graph."""
    return C.components(*_merge_graph(spark, sf_dir))


def g17_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the merge graph by degree."""
    return C.degrees(*_merge_graph(spark, sf_dir)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def l2_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community of each node of the merge graph, nodes of one neighbour pinned."""
    return C.communities(*_merge_graph(spark, sf_dir), 2).labels


def l6_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the propagation was like."""
    nodes, near = _merge_graph(spark, sf_dir)
    parts = C.components(nodes, near)
    return C.metrics(C.communities(nodes, near, 2, parts=parts), parts)


def l7_partition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of the components as a partition."""
    return C.partition_hash(g16_components(spark, sf_dir).withColumnRenamed("component", "label"))


def d16_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo rows of the folds, counted against their victims."""
    graph = memory_graph(spark, sf_dir)
    folds = staged(D.exact_folds(graph.episodic), "folds")
    undo = D.undo_rows(graph.episodic, folds, "run", "2026-10-20T00:00:00+00:00")
    return undo.agg(F.count(F.lit(1)).alias("undo"), F.countDistinct("source_node_uuid").alias("victims"))


QUERIES = {f.__name__: f for f in (s2_group_mentions, s3_relations, d9_self_loops, d10_relation_drops, d12_relations_moved, d13_extra_edges, r4_prune_counters, d1_tokens, d3_pairs, d4_merges, d6_plan, d6_clusters, d7_roots, d11_folds, a11_fold_clusters, d15_fold_mentions, d16_undo, a9_duplicate_mentions, a10_collisions, r2_orphans, r3_prune, g16_components, g17_degrees, l2_communities, l6_metrics, l7_partition_hash)}

_T = lambda c: rf"(try_cast(CASE WHEN regexp_matches({c}, '([zZ]|[+-]\d{{2}}:?\d{{2}})$') THEN {c} WHEN length({c}) = 10 THEN {c} || 'T00:00:00+00:00' ELSE {c} || '+00:00' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC')"
_ONE = lambda t, k, time, cols: f"SELECT * FROM {t} QUALIFY {k} IS NULL OR row_number() OVER (PARTITION BY {k} ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in [_T(time), *cols])}) = 1"
_P = lambda n: f"CASE WHEN json_valid(payload_json) THEN json_extract_string(payload_json, '$.{n}') END"
_W = f"""WITH RECURSIVE en AS ({_ONE('entity', 'uuid', 'created_at', ['name', 'summary', 'created_at', 'group_id'])}), ep AS (SELECT id uuid, {_P('name')} AS name, {_P('content')} content, created_at FROM ({_ONE('episodes', 'id', 'updated_at', ['payload_json', 'created_at', 'updated_at'])})),
me AS (SELECT uuid, src_uuid, dst_uuid, created_at, group_id FROM ({_ONE('(SELECT uuid, coalesce(src_uuid, dst_uuid) src_uuid, coalesce(dst_uuid, src_uuid) dst_uuid, created_at, group_id FROM mentions)', 'uuid', 'created_at', ['src_uuid', 'dst_uuid', 'created_at', 'group_id'])})),
tok AS (SELECT uuid, coalesce(name, '') AS name, list_distinct(regexp_extract_all(lower(coalesce(summary, '')), '[a-z0-9_]+')) w FROM en),
folds AS (SELECT * FROM (SELECT uuid victim_uuid, first_value(uuid) OVER (PARTITION BY coalesce(name, ''), coalesce(content, '') ORDER BY coalesce(created_at, ''), uuid) survivor_uuid FROM ep WHERE coalesce(uuid, '') <> '') WHERE victim_uuid <> survivor_uuid),
mv AS (SELECT me.*, coalesce(f.survivor_uuid, src_uuid) new_src, f.survivor_uuid IS NOT NULL touched FROM me LEFT JOIN folds f ON f.victim_uuid = me.src_uuid),
kk AS (SELECT id, nullif(lower(regexp_replace(source_node_uuid, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')), '') s, nullif(lower(regexp_replace(target_node_uuid, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')), '') t FROM dream_entity_undo_log),
ed AS (SELECT DISTINCT s, t FROM kk WHERE s IS NOT NULL AND t IS NOT NULL), nd AS (SELECT s node FROM ed UNION SELECT t FROM ed),
ad AS (SELECT s a, t b FROM ed WHERE s <> t UNION SELECT t, s FROM ed WHERE s <> t),
rel AS (SELECT uuid, lead src_uuid, dst_uuid, created_at FROM (SELECT *, min(dst_uuid) OVER (PARTITION BY src_uuid) lead FROM me WHERE src_uuid IS NOT NULL AND dst_uuid IS NOT NULL) WHERE lead <> dst_uuid),
last AS (SELECT s v, arg_max(t, (id, t)) r FROM kk WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY s), lk AS (SELECT * FROM last WHERE v <> r),
pth(v, r, p) AS (SELECT v, r, [v] FROM lk UNION ALL SELECT pth.v, lk.r, list_append(p, pth.r) FROM pth JOIN lk ON lk.v = pth.r WHERE NOT list_contains(p, pth.r)),
rt AS (SELECT v victim, CASE WHEN list_contains(p, r) THEN list_min(p[list_position(p, r):]) ELSE r END root FROM pth QUALIFY row_number() OVER (PARTITION BY v ORDER BY len(p) DESC) = 1), roots AS (SELECT * FROM rt WHERE victim <> root),
rk AS (SELECT uuid, nullif(lower(regexp_replace(src_uuid, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')), '') s, nullif(lower(regexp_replace(dst_uuid, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')), '') t, created_at FROM rel),
rm AS (SELECT rk.*, coalesce(a.root, s) ns, coalesce(b.root, t) nt, a.root IS NOT NULL OR b.root IS NOT NULL touched FROM rk LEFT JOIN roots a ON a.victim = s LEFT JOIN roots b ON b.victim = t),
lab(v, l) USING KEY (v) AS (SELECT node, least(node, (SELECT min(b) FROM ad WHERE a = node)) FROM nd UNION SELECT ad.a, min(n.l) FROM recurring.lab n JOIN ad ON ad.b = n.v JOIN recurring.lab o ON o.v = ad.a GROUP BY ad.a, o.l HAVING min(n.l) < o.l)
"""
_TRIM = r"regexp_replace(regexp_replace(coalesce(summary, ''), '^[\s\x1c-\x1f\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''), '[\s\x1c-\x1f\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '')"
_ORPH = f"orph AS (SELECT uuid, name, {_TRIM} = '' prunable, length({_TRIM}) chars FROM en WHERE uuid IS NOT NULL AND uuid NOT IN (SELECT dst_uuid FROM me WHERE dst_uuid IS NOT NULL))"
ORACLES = {
    "s2_group_mentions": _W + f"SELECT src_uuid, count(*) n FROM me WHERE dst_uuid IN (SELECT uuid FROM en WHERE group_id = '{GROUP}') GROUP BY 1",
    "s3_relations": _W + f"SELECT src_uuid, count(*) n FROM rel WHERE src_uuid IN (SELECT uuid FROM en WHERE group_id = '{GROUP}') GROUP BY 1",
    "d7_roots": _W + "SELECT victim, root FROM roots",
    "d9_self_loops": _W + "SELECT uuid, ns node FROM rm WHERE touched AND ns = nt",
    "d10_relation_drops": _W + "SELECT count(*) FILTER (touched AND ns <> nt) relations_moved, count(*) FILTER (touched AND ns = nt) self_loops, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) n FROM rm GROUP BY ns = nt, CASE WHEN ns = nt THEN s ELSE ns END, CASE WHEN ns = nt THEN t ELSE nt END HAVING count(*) > 1 AND bool_or(touched))) relations_dropped FROM rm",
    "d12_relations_moved": _W + "SELECT uuid, ns src_uuid, nt dst_uuid, 'mentioned together' fact, created_at FROM rm WHERE NOT (touched AND ns = nt)",
    "d13_extra_edges": _W + "SELECT uuid, ns src_uuid, nt dst_uuid FROM rm WHERE NOT (touched AND ns = nt) QUALIFY row_number() OVER (PARTITION BY ns, nt ORDER BY touched, created_at, uuid) = 1",
    "r4_prune_counters": _W + "SELECT count(*) FILTER (h AND NOT u) deleted, count(*) FILTER (h AND u) skipped, count(*) FILTER (NOT h) gone FROM (SELECT uuid IN (SELECT uuid FROM en WHERE uuid IS NOT NULL) h, uuid IN (SELECT dst_uuid FROM me WHERE dst_uuid IS NOT NULL) u FROM (SELECT DISTINCT uuid FROM orphan WHERE uuid IS NOT NULL))",
    "d1_tokens": _W + "SELECT uuid, CAST(len(w) AS INTEGER) n_words FROM tok",
    "d3_pairs": _W + ", rep AS (SELECT name, list_sort(w) w, min(uuid) uuid FROM tok GROUP BY 1, 2), sc AS (SELECT a.uuid a, b.uuid b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) score FROM rep a JOIN rep b ON a.name = b.name AND a.uuid < b.uuid WHERE len(a.w) > 0 AND len(b.w) > 0) SELECT a, b, round(score, 6) score FROM sc WHERE score >= 0.5",
    "d6_clusters": _W + "SELECT coalesce(name, '') AS name, count(*) n FROM en GROUP BY 1 HAVING count(*) > 1",
    "d11_folds": _W + "SELECT survivor_uuid, victim_uuid FROM folds",
    "a11_fold_clusters": _W + "SELECT count(*) clusters, CAST(coalesce(sum(n), 0) AS BIGINT) episodes FROM (SELECT count(*) n FROM ep GROUP BY coalesce(name, ''), coalesce(content, '') HAVING count(*) > 1)",
    "d15_fold_mentions": _W + "SELECT new_src src_uuid, count(*) n FROM (SELECT * FROM mv QUALIFY NOT touched OR row_number() OVER (PARTITION BY new_src, dst_uuid ORDER BY touched, created_at, uuid) = 1) GROUP BY 1",
    "d16_undo": _W + "SELECT count(*) undo, count(DISTINCT victim_uuid) victims FROM folds",
    "a9_duplicate_mentions": _W + "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) duplicates FROM (SELECT count(uuid) n FROM me GROUP BY src_uuid, dst_uuid HAVING count(uuid) > 1)",
    "a10_collisions": _W + "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) drops FROM (SELECT count(*) n FROM mv GROUP BY new_src, dst_uuid HAVING count(*) > 1 AND bool_or(touched))",
    "r2_orphans": _W + f", {_ORPH} SELECT * FROM orph",
    "r3_prune": _W + f", {_ORPH} SELECT group_id, count(*) n FROM en WHERE uuid IS NULL OR uuid NOT IN (SELECT uuid FROM orph WHERE prunable) GROUP BY 1",
    "g16_components": _W + "SELECT v node, l component FROM lab",
    "g17_degrees": _W + "SELECT CAST(d AS BIGINT) degree, count(*) n FROM (SELECT node, count(b) d FROM nd LEFT JOIN ad ON a = node GROUP BY 1) GROUP BY 1",
    "l7_partition_hash": _W + ", g AS (SELECT list_sort(list(v)) m FROM lab GROUP BY l) SELECT left(sha256(string_agg(len(m) || ':' || array_to_string(m, chr(31)), '' ORDER BY m)), 16) partition_hash FROM g",
}
