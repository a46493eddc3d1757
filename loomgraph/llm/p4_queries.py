"""Problem 4: the surviving values of merged entities, the surviving orphan of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.text import key_form, utc_time, words
from loomgraph.llm.components import groups_of
from loomgraph.llm.neardup import alike_links
from loomgraph.llm.p3_queries import SHARE, kept_orphans
from loomgraph.llm.survivor import layers, merge_candidates, survivors, text_candidates
from loomgraph.plans.skew import spread_join
from loomgraph.plans.staging import staged
from loomgraph.sources.tables import table


def _orphan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uuid, group_key) of the orphans of groups of at least two, group_key being the lowest uuid in key form."""
    members, links = alike_links(kept_orphans(spark, sf_dir), "uuid", words(F.col("name"), F.col("summary")), SHARE)
    key = lambda c: F.lower(F.hex(c))
    tied = groups_of(links.select(key("h_a").alias("a"), key("h_b").alias("b")), "a", "b").select(F.col("node_key").alias("class_id"), F.col("group_key").alias("g"))
    own = spread_join(members.select("id", key("h").alias("class_id")), tied, "class_id", "left", members.count()).select(F.col("id").alias("uuid"), F.coalesce("g", "class_id").alias("g"))
    own = staged(own.distinct(), "groups")
    lowest = own.groupBy("g").agg(F.min("uuid").alias("lo"), F.max("uuid").alias("hi")).where("lo != hi").select("g", key_form(F.col("lo")).alias("group_key"))
    return spread_join(own, lowest, "g", "inner", own.count()).select("uuid", "group_key")


#: What a group of records is named by.
BY = ["source_table", "group_key", "field_name"]


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    undo, trust = table(spark, sf_dir, "dream_entity_undo_log"), table(spark, sf_dir, "source_trust")
    times = table(spark, sf_dir, "entity").select(key_form(F.col("uuid")).alias("key"), utc_time(F.col("created_at")).alias("created")).groupBy("key").agg(F.min("created").alias("created"))
    texts = text_candidates(_orphan_groups(spark, sf_dir), kept_orphans(spark, sf_dir).select("uuid", "summary"), times)
    merges, levels = merge_candidates(undo, trust)
    return layers(merges.withColumn("source_table", F.lit("dream_entity_undo_log")).unionByName(texts.withColumn("source_table", F.lit("orphan"))), BY, levels)


def p4_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first dominance layers of every group and field."""
    return _layered(spark, sf_dir).select(*BY, "layer", "completeness", "trust", "filled", F.col("key").alias("winner_key"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source or orphan each surviving value comes from."""
    return survivors(_layered(spark, sf_dir), BY).select(*BY, F.col("key").alias("winner_key"))


QUERIES = {"p4_found": p4_found, "p4_fronts": p4_fronts}

_KEY = r"nullif(lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g')), '')"
_SIZE = r"length(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"
_WS = r"[\s\x1c-\x1f\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM = f"regexp_replace(regexp_replace({{0}}, '^{_WS.replace('{', '{{').replace('}', '}}')}+', ''), '{_WS.replace('{', '{{').replace('}', '}}')}+$', '')"
_DAY = "CASE WHEN length({0}) = 10 THEN {0} || 'T00:00:00' ELSE {0} END"
_TIME = r"try_cast(CASE WHEN regexp_matches({0}, '([zZ]|[+-]\d{{2}}:?\d{{2}}|[+-]\d{{2}})$') AND regexp_matches({0}, '\d{{2}}:\d{{2}}') THEN {0} ELSE {0} || '+00:00' END AS TIMESTAMPTZ)"
_AT = lambda c: f"coalesce(epoch_us({_TIME.format('(' + _DAY.format(_TRIM.format(c)) + ')')}), -4611686018427387904)"
_KNOWN = "('name', 'summary', 'entity_type', 'updated_at', 'source_description', 'uuid', 'created_at')"
_FIELD = lambda n: f"""json_extract_string(o, '$."' || list_filter(list_sort(json_keys(o)), lambda k: lower(k) = '{n}')[1] || '"')"""
_GOOD = f"({_SIZE.format('v')} > 0 AND lower({_TRIM.format('v')}) NOT IN ('n/a', 'none', 'null', 'unknown', 'tbd'))"
# the records with their qualities; layers by what is dominated by nothing that is left
_LAYERS = f"""WITH RECURSIVE m AS (SELECT {_KEY.format('target_node_uuid')} g, {_KEY.format('source_node_uuid')} k, CASE WHEN json_valid(source_node_snapshot) THEN source_node_snapshot::JSON END j FROM dream_entity_undo_log),
m1 AS (SELECT g, k, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END j FROM m WHERE g IS NOT NULL AND k IS NOT NULL),
m2 AS (SELECT g, k, CASE WHEN len(list_filter(json_keys(j), lambda k: lower(k) IN {_KNOWN})) > 0 THEN j
  ELSE list_filter(list_transform(list_sort(json_keys(j)), lambda k: json_extract(j, '$."' || k || '"')), lambda x: json_type(x) = 'OBJECT' AND len(list_filter(json_keys(x), lambda y: lower(y) IN {_KNOWN})) > 0)[1] END o
  FROM m1 WHERE json_type(j) = 'OBJECT'),
tr AS (SELECT lower({_TRIM.format('source_description')}) s, min(trust_rank) r FROM source_trust GROUP BY 1),
lv AS (SELECT s, dense_rank() OVER (ORDER BY r DESC) t FROM tr WHERE s IS NOT NULL AND r IS NOT NULL),
f AS (SELECT g, k, {_FIELD('name')} n, {_FIELD('summary')} su, {_FIELD('entity_type')} e, {_AT(_FIELD('updated_at'))} u, lower({_TRIM.format(_FIELD('source_description'))}) src FROM m2 WHERE o IS NOT NULL),
x AS (SELECT g, k, u, coalesce(t, 0) t, unnest([{{'f': 'name', 'v': n}}, {{'f': 'summary', 'v': su}}, {{'f': 'entity_type', 'v': e}}]) y FROM f LEFT JOIN lv ON lv.s = f.src),
y AS (SELECT g, k, u, t, y.f f, y.v v FROM x WHERE g IN (SELECT g FROM m1 GROUP BY g HAVING count(DISTINCT k) > 1)),
o AS (SELECT DISTINCT uuid, list_sort(list_distinct(regexp_extract_all(lower(coalesce(name, '') || ' ' || coalesce(summary, '')), '[a-z0-9_]+'))) w FROM orphan WHERE prunable = false AND uuid IS NOT NULL),
p AS (SELECT uuid, len(w) n, unnest(w) z FROM o),
c AS (SELECT a.uuid ua, b.uuid ub, a.n na, b.n nb, count(*) s FROM p a JOIN p b ON a.z = b.z AND a.uuid < b.uuid AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
pr AS (SELECT ua, ub FROM c WHERE 4 * s >= 3 * na AND 4 * s >= 3 * nb), ad AS (SELECT ua a, ub b FROM pr UNION SELECT ub, ua FROM pr),
lab(v, l) USING KEY (v) AS (SELECT a, least(a, min(b)) FROM ad GROUP BY a UNION SELECT ad.a, min(n.l) FROM recurring.lab n JOIN ad ON ad.b = n.v JOIN recurring.lab q ON q.v = ad.a GROUP BY ad.a, q.l HAVING min(n.l) < q.l),
born AS (SELECT {_KEY.format('uuid')} k, min({_TIME.format('created_at')}) b FROM entity GROUP BY 1),
r AS (
  SELECT DISTINCT 'dream_entity_undo_log' source_table, g group_key, f field_name, CASE WHEN NOT coalesce({_GOOD}, false) THEN 0 WHEN f = 'summary' THEN {_SIZE.format('v')} ELSE 1 END c, t, u, k, coalesce({_GOOD}, false) filled FROM y
  UNION ALL SELECT 'orphan', {_KEY.format('l')}, 'summary', max({_SIZE.format("coalesce(summary, '')")}), 0, coalesce(-epoch_us(any_value(b)), -4611686018427387904), {_KEY.format('v')}, true FROM lab JOIN orphan ON uuid = v AND prunable = false LEFT JOIN born ON born.k = {_KEY.format('v')} GROUP BY l, v),
i AS (SELECT *, row_number() OVER () i FROM r),
d AS (SELECT b.i, a.i dom FROM i a JOIN i b USING (source_table, group_key, field_name) WHERE a.i <> b.i AND a.c >= b.c AND a.t >= b.t AND (a.u > b.u OR a.u = b.u AND a.k < b.k)),
l1 AS (SELECT i FROM i WHERE i NOT IN (SELECT i FROM d)),
l2 AS (SELECT i FROM i WHERE i NOT IN (SELECT i FROM l1) AND i NOT IN (SELECT i FROM d WHERE dom NOT IN (SELECT i FROM l1))),
l3 AS (SELECT i FROM i WHERE i NOT IN (SELECT i FROM l1) AND i NOT IN (SELECT i FROM l2) AND i NOT IN (SELECT i FROM d WHERE dom NOT IN (SELECT i FROM l1) AND dom NOT IN (SELECT i FROM l2))),
la AS (SELECT CAST(1 AS INTEGER) layer, i FROM l1 UNION ALL SELECT 2, i FROM l2 UNION ALL SELECT 3, i FROM l3)
"""
ORACLES = {
    "p4_fronts": _LAYERS + "SELECT source_table, group_key, field_name, layer, CAST(c AS BIGINT) completeness, CAST(t AS INTEGER) trust, filled, k winner_key FROM la JOIN i USING (i)",
    # the stated rules alone: no layers
    "p4_found": _LAYERS + "SELECT source_table, group_key, field_name, k winner_key FROM r WHERE filled QUALIFY row_number() OVER (PARTITION BY source_table, group_key, field_name ORDER BY CASE field_name WHEN 'summary' THEN c WHEN 'entity_type' THEN t ELSE 0 END DESC, u DESC, k) = 1",
}
