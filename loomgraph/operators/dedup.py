"""Merging of near-duplicate entities and folding of identical episodes: plans, counters, and rewritten tables.

Pair scores don't change while entities merge, so the greedy chain per name (best pair first, then input order) is
the scan of all pairs in that order that skips pairs with a merged-away member. Here it runs in rounds: a pair that is
the first among all open pairs at both its ends is applied, its loser leaves, and the rest goes on. Input order is the order of uuids.
Equal word sets merge first and in one pass; other pairs come from an inverted join on words, never from pairing out a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.functions.text import words
from loomgraph.functions.vector import jaccard
from loomgraph.plans.skew import spread_join
from loomgraph.plans.staging import staged

#: Least Jaccard similarity of two summaries that merges their entities.
THRESHOLD = 0.80


def threshold_of(value: object) -> float:
    """A threshold in [0, 1]; anything else is THRESHOLD."""
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= 1 else THRESHOLD


def word_sets(entities: DataFrame) -> DataFrame:
    """(name, h, uuid, w, rank) of entities with a uuid: h names the set of summary words, rank is the survivor order.

    rank: longest summary, then earliest created_at as text (null as the empty text), then lowest uuid.
    """
    w = F.array_sort(words(F.col("summary")))
    length = F.coalesce(F.length("summary"), F.lit(0)).cast("long")
    rank = F.struct((-length).alias("n"), F.coalesce("created_at", F.lit("")).alias("t"), F.col("uuid").alias("u"))
    return entities.where(F.col("uuid").isNotNull()).select(F.coalesce("name", F.lit("")).alias("name"), F.md5(F.concat_ws(" ", w)).alias("h"), "uuid", w.alias("w"), rank.alias("rank"))


def alike_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(name, a, b, score), a < b, of rows (name, uuid, w) with one name and a Jaccard similarity of ``threshold`` (above 0) or more.

    Only rows that share one of their first n - ceil(threshold * n) + 1 words, in an order common to all, are compared:
    no pair at the threshold is lost, and no name is paired out. Rows without words have no pairs here.
    """
    order = F.transform(F.array_sort(F.transform("w", lambda x: F.struct(F.xxhash64(x).alias("o"), x.alias("x")))), lambda s: s["x"])
    prefix = F.size("w") - F.ceil(F.size("w") * threshold - 1e-9) + 1
    posts = sets.where(F.size("w") > 0).select("name", "uuid", F.size("w").alias("n"), F.explode(F.slice(order, 1, prefix.cast("int"))).alias("x"))
    a, b = posts.select("name", "x", F.col("uuid").alias("a"), F.col("n").alias("na")), posts.select("name", "x", F.col("uuid").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["name", "x"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)).select("name", "a", "b").distinct()
    text = lambda s: sets.select("name", F.col("uuid").alias(s), F.col("w").alias(f"w{s}"))
    return met.join(text("a"), ["name", "a"]).join(text("b"), ["name", "b"]).select("name", "a", "b", jaccard(F.col("wa"), F.col("wb")).alias("score")).where(F.col("score") >= threshold)


def equal_merges(sets: DataFrame) -> DataFrame:
    """Merges (name, survivor, victim: ranks) among rows of one name and one set of words, whose similarity is 1.

    They come before all others, in the order of uuids: each row meets the best of those before it.
    """
    before = F.min("rank").over(Window.partitionBy("name", "h").orderBy("uuid").rowsBetween(Window.unboundedPreceding, -1))
    met = sets.withColumn("_b", before).where("_b is not null")
    own = F.col("rank") < F.col("_b")
    return met.select("name", F.when(own, F.col("rank")).otherwise(F.col("_b")).alias("survivor"), F.when(own, F.col("_b")).otherwise(F.col("rank")).alias("victim"))


def greedy_merges(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, survivor_uuid, victim_uuid, similarity, survivor_len, victim_len), the merges of the greedy chain at a threshold above 0."""
    sets = staged(word_sets(entities), "sets")
    best = staged(sets.groupBy("name", "h").agg(F.min("rank").alias("rank"), F.first("w").alias("w")).withColumn("uuid", F.col("rank.u")), "best")
    ranks = best.select("uuid", "rank")
    pairs = alike_pairs(best, threshold).join(ranks.toDF("a", "ra"), "a").join(ranks.toDF("b", "rb"), "b")
    first = F.col("ra") < F.col("rb")
    open_ = staged(pairs.select("name", "a", "b", "score", F.when(first, F.col("ra")).otherwise(F.col("rb")).alias("survivor"), F.when(first, F.col("rb")).otherwise(F.col("ra")).alias("victim")), "pairs")
    done = equal_merges(sets).withColumn("score", F.lit(1.0))
    while not open_.isEmpty():
        place = F.struct((-F.col("score")).alias("s"), "a", "b")
        ends = open_.select(F.explode(F.array("a", "b")).alias("uuid"), place.alias("r")).groupBy("uuid").agg(F.min("r").alias("best"))
        at = open_.withColumn("r", place).join(ends.toDF("a", "best_a"), "a").join(ends.toDF("b", "best_b"), "b")
        applied = staged(at.where("r = best_a and r = best_b").select(*open_.columns), "applied")
        done = done.unionByName(applied.select("name", "survivor", "victim", "score"))
        gone = applied.select("victim.u")
        open_ = staged(open_.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select(*open_.columns), "pairs")
    return done.select("name", F.col("survivor.u").alias("survivor_uuid"), F.col("victim.u").alias("victim_uuid"), F.bround("score", 4).alias("similarity"), (-F.col("survivor.n")).alias("survivor_len"), (-F.col("victim.n")).alias("victim_len"))


def roots(merges: DataFrame) -> DataFrame:
    """(victim, root): chains of merges followed to their last survivor, by pointer jumping; a ring, and what leads into it, ends at its lowest member."""
    low = staged(merges.select(F.col("victim_uuid").alias("victim"), F.col("survivor_uuid").alias("root")).where("victim != root").withColumn("least", F.least("victim", "root")), "links")
    rows, last, steps = low.count(), None, 1
    while True:
        onward = low.select(F.col("victim").alias("root"), F.col("root").alias("far"), F.col("least").alias("far_least"))
        jumped = spread_join(low.select("victim", "root", "least"), onward, "root", "left", rows)
        low = staged(jumped.select("victim", F.coalesce("far", "root").alias("root"), F.least("least", F.coalesce("far_least", "least")).alias("least"), F.col("far").isNotNull().alias("moved")), "links", low)
        moving = low.where("moved").agg(F.sum(F.xxhash64("victim", "least").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
        steps *= 2
        if moving["n"] == 0:
            return low.select("victim", "root")
        if tuple(moving) == last and steps >= 2 * moving["n"]:
            # only rings still move, and every root is in its ring, all of whose members know the lowest
            lowest = low.where("moved").select(F.col("victim").alias("root"), F.col("least").alias("_lowest"))
            ring = spread_join(low.select("victim", "root"), lowest, "root", "left", rows).select("victim", F.coalesce("_lowest", "root").alias("root"))
            return ring.where("victim != root")
        last = tuple(moving)


def redirected(edges: DataFrame, moves: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with ``columns`` set to the root of what they name, and ``touched`` if any was. moves: (victim, root), a victim once."""
    out, touched = edges, F.lit(False)
    for c in columns:
        out = spread_join(out, moves.select(F.col("victim").alias(c), F.col("root").alias(f"_{c}")), c, "left")
        touched = touched | F.col(f"_{c}").isNotNull()
    return out.withColumn("touched", touched).withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*edges.columns, "touched")


def redirected_relations(relations: DataFrame, moves: DataFrame) -> DataFrame:
    """Relations with both ends moved, ``touched``, ``self_loop`` if moving made the ends one, and the ends as they were (raw_src, raw_dst)."""
    raw = relations.withColumns({"raw_src": F.col("src_uuid"), "raw_dst": F.col("dst_uuid")})
    return redirected(raw, moves, ["src_uuid", "dst_uuid"]).withColumn("self_loop", F.coalesce(F.col("touched") & (F.col("src_uuid") == F.col("dst_uuid")), F.lit(False)))


def relation_counters(relations: DataFrame, moves: DataFrame) -> DataFrame:
    """One row on what a merge does to relations: moved, made self-loops, and surplus among equals that it makes.

    Equals have the same ends and fact after the move; loops are equal by their ends before it, so that parallel ones count as surplus too.
    """
    moved = staged(redirected_relations(relations, moves), "relations")
    loop = F.coalesce(F.col("src_uuid") == F.col("dst_uuid"), F.lit(False))
    side = lambda c: F.when(loop, F.col(f"raw_{c}")).otherwise(F.col(f"{c}_uuid"))
    keyed = moved.select("touched", loop.alias("loop"), F.coalesce(side("src"), F.lit("")).alias("s"), F.coalesce(side("dst"), F.lit("")).alias("d"), F.when(loop, "").otherwise(F.coalesce("fact", F.lit(""))).alias("f"))
    counts = moved.agg(F.count_if(F.col("touched") & ~F.col("self_loop")).alias("relations_moved"), F.count_if("self_loop").alias("self_loops"))
    return counts.join(F.broadcast(collisions(keyed, ["loop", "s", "d", "f"]).withColumnRenamed("drops", "relations_dropped")))  # one row each


def apply_relations(relations: DataFrame, moves: DataFrame, drop_duplicates: bool = True, touched_only: bool = True) -> DataFrame:
    """Relations after the merges: moved at both ends, new self-loops gone, of equals (ends and fact) the first by created_at and uuid.

    All columns stay. With touched_only, equals that no merge touched are kept as they are; without, the whole table is made distinct.
    """
    moved = redirected_relations(relations, moves).where(~F.col("self_loop"))
    if drop_duplicates:
        equal = Window.partitionBy("src_uuid", "dst_uuid", F.coalesce("fact", F.lit("")))
        hit = F.max(F.col("touched").cast("int")).over(equal) if touched_only else F.lit(1)
        moved = moved.withColumns({"_hit": hit, "_n": F.row_number().over(equal.orderBy("touched", "created_at", "uuid"))}).where("_n = 1 or _hit = 0")
    return moved.select(*relations.columns)


def collisions(edges: DataFrame, key: list[str]) -> DataFrame:
    """One row (drops): edges beyond the first of each key that has at least one touched edge."""
    groups = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_or("touched").alias("hit")).where("n > 1 and hit")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("drops"))


def duplicate_edges(edges: DataFrame, key: list[str], ident: str = "uuid") -> DataFrame:
    """One row (duplicates): edges with an id beyond the first of each key."""
    return edges.groupBy(*key).agg(F.count(ident).alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def highest_similarity(sets: DataFrame, floor: float = 0.5) -> DataFrame:
    """One row (max_similarity): the highest similarity of two rows of a name, 0 if no two share a word.

    It is looked for from ``floor`` up, and where nothing is found from half of it, so that names whose rows are alike aren't paired out;
    in the end, whatever shares a word is compared.
    """
    equal = sets.groupBy("name", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(1.0).alias("score"))
    best = staged(sets.groupBy("name", "h").agg(F.min("uuid").alias("uuid"), F.first("w").alias("w")), "best")
    if not equal.isEmpty():
        return equal.agg(F.max("score").alias("max_similarity"))
    least = best.agg(F.max(F.size("w"))).first()[0] or 0
    while True:
        found = staged(alike_pairs(best, floor).agg(F.max("score").alias("m")), "highest")
        if found.first()["m"] is not None or floor <= 1e-9:
            return found.select(F.coalesce(F.bround("m", 4), F.lit(0.0)).alias("max_similarity"))
        floor = floor / 2 if floor / 2 > 1 / (2 * least + 1) else 1e-9


def plan_counters(entities: DataFrame, mentions: DataFrame, threshold: float = THRESHOLD, relations: DataFrame | None = None) -> DataFrame:
    """One row on a merge plan: clusters, nodes in them, merges, highest similarity, characters saved, mentions to move and to drop.

    With ``relations``, their counters stand beside.
    """
    merges = staged(greedy_merges(entities, threshold), "merges")
    names = entities.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    clusters = names.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("cluster_nodes"))
    highest = highest_similarity(staged(word_sets(entities), "sets"))
    merged = merges.agg(F.count(F.lit(1)).alias("merges"), F.coalesce(F.sum("victim_len"), F.lit(0)).alias("chars_saved"))
    moves = staged(roots(merges), "moves")
    moved = staged(redirected(mentions, moves, ["dst_uuid"]), "moved")
    counts = moved.agg(F.count_if("touched").alias("mentions_moved"))
    out = clusters
    for one in (highest, merged, counts, collisions(moved, ["src_uuid", "dst_uuid"]).withColumnRenamed("drops", "mentions_dropped")):
        out = out.join(F.broadcast(one))  # one row each
    return out if relations is None else out.join(F.broadcast(relation_counters(relations, moves)))


def apply_merges(entities: DataFrame, mentions: DataFrame, merges: DataFrame, drop_duplicates: bool = True, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(entities, mentions, relations) after the merges: edges of victims go to their survivors, victims without an edge leave.

    With drop_duplicates a pair that a merge made double keeps its first edge by created_at and uuid; other pairs stay as they are.
    """
    moves = staged(roots(merges), "moves")
    moved = redirected(mentions, moves, ["dst_uuid"])
    if drop_duplicates:
        pair = Window.partitionBy("src_uuid", "dst_uuid")
        moved = moved.withColumns({"_hit": F.max(F.col("touched").cast("int")).over(pair), "_n": F.row_number().over(pair.orderBy("touched", "created_at", "uuid"))}).where("_n = 1 or _hit = 0").drop("_hit", "_n")
    moved = moved.drop("touched")
    facts = None if relations is None else staged(apply_relations(relations, moves, drop_duplicates), "relations")
    ends = moved.select(F.col("dst_uuid").alias("uuid"))
    if facts is not None:
        ends = ends.unionByName(facts.select(F.explode(F.array("src_uuid", "dst_uuid")).alias("uuid")))
    gone = moves.select(F.col("victim").alias("uuid")).join(ends.distinct(), "uuid", "left_anti")
    return entities.join(gone, "uuid", "left_anti").select(*entities.columns), moved, facts


def exact_folds(episodic: DataFrame) -> DataFrame:
    """(name, survivor_uuid, victim_uuid) of episodes equal in name and content: the earliest created_at, then the lowest uuid survives."""
    own = episodic.where(F.coalesce("uuid", F.lit("")) != "").select("uuid", F.coalesce("name", F.lit("")).alias("name"), F.sha1(F.coalesce("content", F.lit(""))).alias("h"), F.coalesce("created_at", F.lit("")).alias("t"))
    own = own.withColumn("k", F.sha1(F.concat_ws("\x1f", "name", "h")))
    first = own.groupBy("k").agg(F.min_by("uuid", F.struct("t", "uuid")).alias("survivor_uuid"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return spread_join(own, first, "k").where("uuid != survivor_uuid").select("name", "survivor_uuid", F.col("uuid").alias("victim_uuid"))


def foldable(folds: DataFrame, mentions: DataFrame, edgeless: bool = True) -> DataFrame:
    """The folds to apply: all, or without ``edgeless`` none at all if no victim has a mention, as the reference refuses such a plan."""
    if edgeless or not folds.join(mentions.select(F.col("src_uuid").alias("victim_uuid")), "victim_uuid", "left_semi").isEmpty():
        return folds
    return folds.where(F.lit(False))


def fold_mentions(mentions: DataFrame, folds: DataFrame) -> DataFrame:
    """Mentions with what victims mention moved to their survivors; a pair the survivor has, or gets twice, comes once (own edges first, then created_at, uuid)."""
    moved = redirected(mentions, folds.select(F.col("victim_uuid").alias("victim"), F.col("survivor_uuid").alias("root")), ["src_uuid"])
    first = F.row_number().over(Window.partitionBy("src_uuid", "dst_uuid").orderBy("touched", "created_at", "uuid"))
    return moved.withColumn("_n", first).where("not touched or _n = 1").drop("_n", "touched")


def undo_rows(rows: DataFrame, merges: DataFrame, run_id: str, now: str) -> DataFrame:
    """One undo row a victim: the run, both ends, and the victim's row as JSON; written before anything is deleted."""
    own = rows.select(F.col("uuid").alias("victim_uuid"), F.to_json(F.struct(*rows.columns)).alias("source_node_snapshot"))
    return merges.join(own, "victim_uuid").select(F.lit(run_id).alias("run_id"), F.col("victim_uuid").alias("source_node_uuid"), F.col("survivor_uuid").alias("target_node_uuid"), "source_node_snapshot", F.lit(now).alias("created_at"))


def report_text(merges: int, threshold: float, highest: float) -> str:
    """A line on a plan that also says why nothing merged."""
    if merges:
        return f"{merges} merges at threshold {threshold:.2f}"
    return f"0 mergeable pairs at threshold {threshold:.2f}; max observed similarity {highest:.4f}"
