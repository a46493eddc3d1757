"""Best representative of each duplicate group: dominance layers of records, resolved by a policy, field by field.

Per group and field a record has three qualities, each the higher the better: completeness (how much its value of the
field says, 0 for a null or unusable value), trust in its source, and recency, whose ties go to the lower key. A record dominates another
if it is no worse in all three and better in one. The first layer holds the undominated records of a group, the next
layer those that only earlier layers dominate, and so on (``layers``). The policy, lexicographic in the qualities that
its field goes by, picks the winner among the records of a layer that have a value; a field that is null throughout a
layer is filled from the next (``survivors``).

No group is gathered in a task: of records equal in completeness and trust only the best few can be in the first layers, and they are
picked before the group meets; what is left streams through one sort by completeness, with a running best for each level of trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.text import key_form, letters_digits, stripped, utc_time
from loomgraph.plans.skew import spread_join
from loomgraph.plans.staging import staged

#: Values that say nothing, without outer blanks and in lower case.
EMPTY_VALUES = ["n/a", "none", "null", "unknown", "tbd"]
#: Second quality of a record without a readable time: behind all others.
NO_TIME = -(1 << 62)
#: Levels of trust at most: each is a running minimum of its own.
LEVELS = 100
#: Layers that are told apart.
DEPTH = 3


def letters_count(text: Column) -> Column:
    """Number of letters and digits; 0 for null."""
    return F.coalesce(F.length(letters_digits(text)), F.lit(0)).cast("long")


def usable(value: Column) -> Column:
    """Has a letter or digit and isn't one of EMPTY_VALUES."""
    return F.coalesce((letters_count(value) > 0) & ~F.lower(stripped(value)).isin(EMPTY_VALUES), F.lit(False))


def recency(text: Column) -> Column:
    """Microseconds of a time text; NO_TIME if it is absent or unreadable."""
    return F.coalesce(F.unix_micros(utc_time(text)), F.lit(NO_TIME))


def layers(candidates: DataFrame, by: list[str], levels: int, depth: int = DEPTH) -> DataFrame:
    """Distinct records (by, completeness, trust, recency, key, filled) of the first ``depth`` layers of each group, with ``layer``.

    trust is a level from 0 to ``levels`` - 1; completeness and recency are whole numbers; none of them is null. Of records
    equal in completeness and trust, those behind ``depth`` others can't be in these layers. ``filled`` goes with the record.
    """
    if not 1 <= levels <= LEVELS:
        raise ValueError(f"1 to {LEVELS} levels of trust")
    own = candidates.select(*by, "completeness", "trust", F.struct((-F.col("recency")).alias("back"), F.col("key").alias("key")).alias("place"), "filled").distinct()
    equal = Window.partitionBy(*by, "completeness", "trust").orderBy("place")
    open_ = own.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= depth).drop("_n").withColumn("layer", F.lit(None).cast("int"))
    ahead = Window.partitionBy(*by).orderBy(F.col("completeness").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for n in range(1, depth + 1):
        best = F.array(*[F.min(F.when(F.col("layer").isNull() & (F.col("trust") >= t), F.col("place"))).over(ahead) for t in range(levels)])
        open_ = open_.withColumn("_best", best).withColumn("layer", F.coalesce("layer", F.when(F.get("_best", F.col("trust").cast("int")) == F.col("place"), F.lit(n)))).drop("_best")
    return open_.where("layer is not null").select(*by, "completeness", "trust", (-F.col("place.back")).alias("recency"), F.col("place.key").alias("key"), "filled", "layer")


def policy() -> Column:
    """What a field's policy goes by before recency and the lower key: summary by completeness, entity_type by trust, name by neither."""
    return F.when(F.col("field_name") == "summary", F.col("completeness")).when(F.col("field_name") == "entity_type", F.col("trust")).otherwise(F.lit(0)).cast("long")


def survivors(layered: DataFrame, by: list[str]) -> DataFrame:
    """(by, layer, key): each group's winner by policy among the filled records of the first layer that has any; no row for a group without a value."""
    order = F.struct("layer", (-policy()).alias("first"), (-F.col("recency")).alias("back"), "key")
    return layered.where("filled").groupBy(*by).agg(F.min(order).alias("best")).select(*by, "best.layer", "best.key")


def with_snapshot_fields(rows: DataFrame, snapshot: str, names: list[str]) -> DataFrame:
    """``rows`` whose ``snapshot`` holds an object, with its named properties as texts.

    A snapshot that is no complete JSON, or holds no object, drops its row. The object may be the snapshot, be held one
    level down, or either of these may be written as a JSON text. The object that has any of the names (in any letter
    case) counts; one level down, the first by name of its holder. Each step is a projection of its own: a parsed value
    is used more than once, and the optimizer keeps such steps apart.
    """
    listed = lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(F.lower(k).alias("k"), F.try_element_at(m, k).alias("v")))
    known = lambda e: F.exists(e, lambda x: x["k"].isin(names))
    as_map = lambda v: v.try_cast("map<string,variant>")
    text = F.ltrim(F.col(snapshot)).startswith('"')
    parsed = rows.withColumn("_o", F.try_parse_json(snapshot)).withColumn("_t", F.when(text, F.try_parse_json(F.col("_o").try_cast("string"))).otherwise(F.col("_o")))
    top = parsed.withColumn("_m", as_map(F.col("_t"))).where("_m is not null").withColumn("_e", listed(F.col("_m")))
    inner = F.get(F.filter(F.transform("_e", lambda x: listed(as_map(x["v"]))), lambda e: F.coalesce(known(e), F.lit(False))), F.lit(0))
    chosen = top.withColumn("_c", F.when(known(F.col("_e")), F.col("_e")).otherwise(inner)).where("_c is not null")
    field = lambda n: F.get(F.filter("_c", lambda x: x["k"] == n), F.lit(0))["v"].cast("string")
    return chosen.withColumns({n: field(n) for n in names}).drop("_o", "_t", "_m", "_e", "_c")


def trust_levels(trust: DataFrame) -> tuple[DataFrame, int]:
    """Sources (in lower case, without outer blanks) with their level, the least trusted 1, and the number of levels; 0 is for all others."""
    ranks = trust.select(F.lower(stripped(F.col("source_description"))).alias("source"), "trust_rank").where("source is not null and trust_rank is not null").groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    known = [r["trust_rank"] for r in ranks.select("trust_rank").distinct().orderBy(F.col("trust_rank").desc()).limit(LEVELS).collect()]
    if len(known) == LEVELS:
        raise ValueError(f"{LEVELS} or more ranks of trust")
    level = F.array_position(F.array(*[F.lit(r) for r in known]), F.col("trust_rank")) if known else F.lit(0)
    return ranks.select("source", level.cast("int").alias("trust")), len(known) + 1


def merge_candidates(undo: DataFrame, trust: DataFrame) -> tuple[DataFrame, int]:
    """Candidates (group_key, field_name, completeness, trust, recency, key, filled) of the merges of targets with several sources, and the levels of trust.

    Every readable snapshot is a candidate for each field, with completeness 0 where its value is null or unusable.
    Rows with a blank source or target take no part.
    """
    names = ["name", "summary", "entity_type", "updated_at", "source_description", "uuid", "created_at"]
    rows = undo.select(key_form(F.col("target_node_uuid")).alias("group_key"), key_form(F.col("source_node_uuid")).alias("key"), "source_node_snapshot").where("group_key is not null and key is not null")
    several = rows.groupBy("group_key").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("group_key")
    sources, levels = trust_levels(trust)
    fields = with_snapshot_fields(rows, "source_node_snapshot", names)
    read = fields.select("group_key", "key", "name", "summary", "entity_type", recency(F.col("updated_at")).alias("recency"), F.lower(stripped(F.col("source_description"))).alias("source"))
    trusted = read.join(F.broadcast(sources), "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))  # fewer sources than have been listed by hand
    one = lambda field: F.struct(F.lit(field).alias("field_name"), F.col(field).alias("value"))
    each = trusted.select("group_key", "key", "recency", "trust", F.explode(F.array(one("name"), one("summary"), one("entity_type"))).alias("x"))
    judged = each.select("group_key", "key", "recency", "trust", "x.field_name", "x.value", usable(F.col("x.value")).alias("filled"))
    size = F.when(~F.col("filled"), 0).when(F.col("field_name") == "summary", letters_count(F.col("value"))).otherwise(1)
    own = judged.select("group_key", "field_name", size.cast("long").alias("completeness"), "trust", "recency", "key", "filled").distinct()
    return spread_join(staged(own, "candidates"), several.withColumn("several", F.lit(True)), "group_key").drop("several"), levels


def text_candidates(grouped: DataFrame, texts: DataFrame, times: DataFrame) -> DataFrame:
    """Candidates of groups of texts: grouped (uuid, group_key), texts (uuid, summary), times (key, created): longer first, then earlier."""
    size = texts.groupBy("uuid").agg(F.max(letters_count(F.col("summary"))).alias("completeness"))
    own = grouped.join(size, "uuid").withColumn("key", key_form(F.col("uuid")))
    timed = own.join(times, "key", "left")
    return timed.select("group_key", F.lit("summary").alias("field_name"), "completeness", F.lit(0).alias("trust"), F.coalesce(-F.unix_micros("created"), F.lit(NO_TIME)).alias("recency"), "key", F.lit(True).alias("filled"))
