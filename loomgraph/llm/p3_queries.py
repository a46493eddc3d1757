"""Problem 3 on the orphans: slightly rewritten copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.text import words
from loomgraph.llm.components import groups_of
from loomgraph.llm.neardup import alike_ids, alike_links
from loomgraph.plans.skew import spread_join
from loomgraph.sources.tables import table

#: Least share of the words of either orphan that are shared.
SHARE = 0.75


def kept_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans with text in their summary."""
    return table(spark, sf_dir, "orphan").where(F.col("prunable") == F.lit(False))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of orphans that are alike enough."""
    pairs = alike_ids(kept_orphans(spark, sf_dir), "uuid", words(F.col("name"), F.col("summary")), SHARE)
    return pairs.select(F.col("id_a").alias("uuid_a"), F.col("id_b").alias("uuid_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per orphan: the class of its words, the class's group of alike classes and its number of links to other classes."""
    members, links = alike_links(kept_orphans(spark, sf_dir), "uuid", words(F.col("name"), F.col("summary")), SHARE)
    key = lambda c: F.lower(F.hex(c))
    pairs = links.select(key("h_a").alias("a"), key("h_b").alias("b"))
    grouped = groups_of(pairs, "a", "b").withColumnRenamed("node_key", "class_id")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    own = spread_join(members.select(F.col("id").alias("uuid"), key("h").alias("class_id")), grouped.join(degree, "class_id"), "class_id", "left", members.count())
    return own.select("uuid", "class_id", F.coalesce("group_key", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

# all pairs in SQL: the words of the orphans in an inverted list, shared words counted
ORACLES = {
    "p3_groups": """
WITH RECURSIVE o AS (SELECT DISTINCT uuid, list_sort(list_distinct(regexp_extract_all(lower(coalesce(name, '') || ' ' || coalesce(summary, '')), '[a-z0-9_]+'))) w FROM orphan WHERE prunable = false AND uuid IS NOT NULL),
h AS (SELECT uuid, w, md5(array_to_string(w, ' ')) h FROM o), k AS (SELECT DISTINCT h, len(w) n, w FROM h),
p AS (SELECT h, n, unnest(w) x FROM k),
c AS (SELECT a.h ha, b.h hb, a.n na, b.n nb, count(*) s FROM p a JOIN p b ON a.x = b.x AND a.h <> b.h AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
ad AS (SELECT ha a, hb b FROM c WHERE 4 * s >= 3 * na AND 4 * s >= 3 * nb),
lab(v, l) USING KEY (v) AS (SELECT a, least(a, min(b)) FROM ad GROUP BY a UNION SELECT ad.a, min(n.l) FROM recurring.lab n JOIN ad ON ad.b = n.v JOIN recurring.lab q ON q.v = ad.a GROUP BY ad.a, q.l HAVING min(n.l) < q.l)
SELECT uuid, h class_id, coalesce(l, h) group_id, (SELECT count(*) FROM ad WHERE a = h) n_links FROM h LEFT JOIN lab ON v = h
""",
    "p3_found": """
WITH o AS (SELECT DISTINCT uuid, list_distinct(regexp_extract_all(lower(coalesce(name, '') || ' ' || coalesce(summary, '')), '[a-z0-9_]+')) w FROM orphan WHERE prunable = false AND uuid IS NOT NULL),
p AS (SELECT uuid, len(w) n, unnest(w) x FROM o),
c AS (SELECT a.uuid ua, b.uuid ub, a.n na, b.n nb, count(*) s FROM p a JOIN p b ON a.x = b.x AND a.uuid < b.uuid AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL)
SELECT DISTINCT ua uuid_a, ub uuid_b FROM c WHERE 4 * s >= 3 * na AND 4 * s >= 3 * nb
""",
}
