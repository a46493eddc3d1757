"""Duplicates hidden by formatting: canonical texts hashed to 128 bits and counted with map-side combining.

A payload is reduced to the letters and digits of its fields, letter case levelled, each field in its place whatever
the order it was written in. The canonical text is hashed to 128 bits (MD5, here only a fingerprint) and a second,
independent 64 bits; groups form on both. The aggregation carries the range of a third hash and of the lengths: a
group in which these differ holds different texts under one fingerprint, and the query fails rather than merge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.text import folded, letters_digits
from loomgraph.plans.skew import spread_join
from loomgraph.plans.staging import staged

#: Between the fields of a canonical text; it is no letter or digit.
BETWEEN = "\x1f"


def json_field(obj: Column, name: str) -> Column:
    """The text of an object's property (a map of variants), its name in any letter case; null if absent or null.

    Of several names that differ by letter case only, the first in order of name counts. Numbers, booleans, arrays
    and objects give their JSON text.
    """
    hits = F.filter(F.array_sort(F.map_entries(obj)["key"]), lambda k: F.lower(k) == name)
    return F.try_element_at(obj, F.get(hits, F.lit(0))).cast("string")


def canonical_payload(payload: Column, fields: list[str]) -> Column:
    """Canonical text of a JSON object; null for a text that is no complete JSON object."""
    obj = F.try_parse_json(payload).try_cast("map<string,variant>")
    return F.when(obj.isNotNull(), F.concat_ws(BETWEEN, *[folded(letters_digits(F.coalesce(json_field(obj, f), F.lit("")))) for f in fields]))


def fingerprints(rows: DataFrame, ident: str, canonical: Column) -> DataFrame:
    """(id, h, x, z, n) of each row with an id and a canonical text: 128 bits, 64 bits, 32 bits, length."""
    texts = rows.select(F.col(ident).alias("id"), canonical.alias("c")).where(F.col("id").isNotNull() & F.col("c").isNotNull())
    return texts.select("id", F.unhex(F.md5("c")).alias("h"), F.xxhash64("c").alias("x"), F.crc32("c").alias("z"), F.length("c").alias("n"))


def copy_groups(prints: DataFrame) -> DataFrame:
    """(h, x, first_id, copies): a row per canonical text, copies being its rows; collisions raise an error."""
    grouped = prints.groupBy("h", "x").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("copies"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    clash = (F.col("z0") != F.col("z1")) | (F.col("n0") != F.col("n1"))
    return grouped.withColumn("first_id", F.when(clash, F.raise_error(F.lit("different texts under one fingerprint"))).otherwise(F.col("first_id"))).drop("z0", "z1", "n0", "n1")


def formatting_copies(rows: DataFrame, ident: str, canonical: Column) -> DataFrame:
    """(first_id, copy_id) for each id of a group of at least two different ids, other than the group's lowest.

    Rows without an id or without a canonical text are no case; a repeated row counts once; of an id with several
    texts each text counts. Empty tables give no rows.
    """
    prints = staged(fingerprints(rows, ident, canonical), "prints")
    groups = copy_groups(prints).where("first_id != last_id").select(F.struct("h", "x").alias("key"), "first_id")
    keyed = prints.select("id", F.struct("h", "x").alias("key"))
    return spread_join(keyed, groups, "key", "inner", prints.count()).where("id != first_id").select("first_id", F.col("id").alias("copy_id")).distinct()
