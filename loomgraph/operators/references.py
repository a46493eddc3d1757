"""Orphan references: compressed runs of parent keys and an as-of match of the keys referred to.

Parent keys are read as integers (32 hexadecimal digits), sorted and compressed into runs of successive values.
The distinct referenced keys are matched as of the preceding run start; a key beyond the end of that run has no
parent. A run carries the parents' own times, so the same pass tells which parents came later than a reference.
Keys of another form (not 32 hexadecimal digits) make runs of one key and match by equality in the same pass.

Both sides are cut at the same quantiles of a sample of all keys, parents' and referred ones, compared as texts, so each piece is matched in a task of its own
and no run crosses a piece. The number of pieces follows the number of keys. References are reduced to distinct keys by map-side combining before they move; only
the keys in question (missing, or earlier than their parent) meet the records again, hot ones spread over salts.

Defined cases: null and blank references are no cases; an unreadable time is never late, of a parent nor of a
record, and such a record's period is null; repeated records count once; empty tables give no parents or no cases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.text import key_form, month, utc_time
from loomgraph.plans.skew import spread_join
from loomgraph.plans.staging import staged

#: Keys of one run; bounds the array of times that a run carries.
RUN_KEYS = 1024
#: Keys of a piece on average, pieces at most (their bounds are held on the driver), sampled keys for each bound.
PIECE_KEYS, PIECES, SAMPLED = 20_000, 16_384, 32

_HEX = "^[0-9a-f]{32}$"


def _low(key: Column) -> Column:
    """The lower 64 bits of a hexadecimal key as a signed number; null for other keys."""
    return F.when(key.rlike(_HEX), F.conv(F.substring(key, 17, 16), 16, -10).cast("long"))


def key_bounds(keys: DataFrame, rows: int) -> list[str]:
    """Bounds that cut ``keys`` (a column key, ``rows`` rows) in pieces of about PIECE_KEYS, from the first keys by hash."""
    pieces = min(PIECES, math.ceil(rows / PIECE_KEYS))
    if pieces < 2:
        return []
    taken = sorted(r["key"] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(pieces * SAMPLED).collect())  # bounded
    return sorted({taken[len(taken) * i // pieces] for i in range(1, pieces)})


def _with_piece(keys: DataFrame, bounds: list[str]) -> DataFrame:
    """``keys`` with ``_piece``: how many bounds aren't beyond the key, twice, and one more for hexadecimal keys, which stand apart."""
    wide = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    cuts = F.broadcast(keys.sparkSession.createDataFrame([([g[0] for g in groups], groups)], "_outer array<string>, _inner array<array<string>>"))  # one row
    upto = lambda a: F.size(F.filter(a, lambda b: b <= F.col("key")))
    at = keys.join(cuts).withColumn("_g", upto(F.col("_outer")))
    inner = F.when(F.col("_g") > 0, (F.col("_g") - 1) * wide + upto(F.get("_inner", F.col("_g") - 1))).otherwise(0)
    return at.withColumn("_piece", inner * 2 + F.col("key").rlike(_HEX).cast("int")).drop("_outer", "_inner", "_g")


def parent_keys(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Distinct keys (``key``) of a parent table in key form with their earliest time (``own_time``)."""
    return rows.select(key_form(F.col(key)).alias("key"), utc_time(F.col(time)).alias("t")).where(F.col("key").isNotNull()).groupBy("key").agg(F.min("t").alias("own_time"))


def key_runs(parents: DataFrame, run_keys: int = RUN_KEYS) -> DataFrame:
    """Runs (parent, _piece, run_start, run_end, times) of the distinct keys (parent, key, own_time, _piece).

    A run ends where the next key isn't the successor, where the lower 64 bits wrap, at a piece's bound, and at
    ``run_keys`` keys.
    """
    order = Window.partitionBy("parent", "_piece").orderBy("key")
    low = _low(F.col("key"))
    same_high = F.substring("key", 1, 16) == F.substring(F.lag("key").over(order), 1, 16)
    follows = same_high & (F.lag(low).over(order) == low - 1) & (low != F.lit(-(1 << 63)))
    starts = parents.withColumn("_start", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    numbered = starts.withColumn("_run", F.sum("_start").over(order))
    # within a run, keys are consecutive: the distance to the run's own start cuts it into bounded parts
    own_start = F.last(F.when(F.col("_start") == 1, low), ignorenulls=True).over(order)
    cut = numbered.withColumn("_part", F.floor((low - own_start) / run_keys))
    return (
        cut.groupBy("parent", "_piece", "_run", "_part")
        .agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"), F.array_sort(F.collect_list(F.struct("key", "own_time"))).alias("_k"))
        .select("parent", "_piece", "run_start", "run_end", F.col("_k.own_time").alias("times"))
    )


def as_of_runs(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """``asked`` (parent, key, _piece, ...) with ``found`` and ``own_time`` from the run that starts at the key or before."""
    extra = [c for c in asked.columns if c not in ("parent", "key", "_piece")]
    types = dict(asked.dtypes)
    left = runs.select("parent", "_piece", F.col("run_start").alias("key"), F.struct("run_start", "run_end", "times").alias("_r"), *[F.lit(None).cast(types[c]).alias(c) for c in extra])
    right = asked.select("parent", "_piece", "key", F.lit(None).cast(left.schema["_r"].dataType).alias("_r"), *extra, F.lit(True).alias("_asked"))
    both = left.withColumn("_asked", F.lit(False)).unionByName(right)
    # a run sorts before a key equal to its start
    order = Window.partitionBy("parent", "_piece").orderBy("key", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_run")
    hexa = F.col("key").rlike(_HEX)
    found = F.coalesce(F.when(hexa, at["run_start"].rlike(_HEX) & (F.col("key") <= at["run_end"])).otherwise(at["run_start"] == F.col("key")), F.lit(False))
    place = F.when(hexa, (_low(F.col("key")) - _low(at["run_start"])).cast("int")).otherwise(0)
    return (
        both.withColumn("_run", F.last("_r", ignorenulls=True).over(order))
        .where("_asked")
        .withColumn("found", found)
        .withColumn("own_time", F.when(F.col("found"), F.get(at["times"], place)))
        .drop("_r", "_run", "_asked")
    )


def references(rows: DataFrame, table: str, record: str, field: str, parent: str, time: str) -> DataFrame:
    """References of one field: table_name, field_name, record_key (text), parent, key (key form), ref_time; blank keys are left out."""
    return rows.select(
        F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), F.col(record).cast("string").alias("record_key"), F.lit(parent).alias("parent"), key_form(F.col(field)).alias("key"), utc_time(F.col(time)).alias("ref_time")
    ).where(F.col("key").isNotNull())


def orphan_references(refs: DataFrame, parents: DataFrame, moved: DataFrame | None = None, moved_parent: str | None = None) -> DataFrame:
    """Cases (table_name, field_name, record_key, period, kind) among ``refs``.

    refs: as references() gives them, any number of fields in one frame; parents: parent, key, own_time with distinct keys;
    moved: keys (``key``) that were merged away, for references to ``moved_parent``.
    kind is late, deleted or missing.
    """
    refs = staged(refs, "references")
    parents = staged(parents, "parents")
    asked = staged(refs.groupBy("parent", "key").agg(F.min("ref_time").alias("earliest")), "asked")
    keys = parents.select("key").unionByName(asked.select("key"))
    cut = key_bounds(keys, keys.count())
    matched = as_of_runs(_with_piece(asked, cut), key_runs(_with_piece(parents, cut)))
    doubtful = matched.where(~F.col("found") | (F.col("own_time") > F.col("earliest"))).select("parent", "key", "found", "own_time")
    if moved is not None:
        gone = moved.select("key").where(F.col("key").isNotNull()).distinct().select(F.lit(moved_parent).alias("parent"), "key", F.lit(True).alias("gone"))
        doubtful = doubtful.join(gone, ["parent", "key"], "left")
    else:
        doubtful = doubtful.withColumn("gone", F.lit(False))
    named = F.concat_ws(":", "parent", "key").alias("_named")
    asking = refs.select("table_name", "field_name", "record_key", "ref_time", named)
    kind = F.when(F.col("found"), F.when(F.col("own_time") > F.col("ref_time"), "late")).when(F.coalesce(F.col("gone"), F.lit(False)), "deleted").otherwise("missing")
    return (
        spread_join(asking, doubtful.select(named, "found", "own_time", "gone"), "_named", "inner", refs.count())
        .select("table_name", "field_name", "record_key", month(F.col("ref_time")).alias("period"), kind.alias("kind"))
        .where(F.col("kind").isNotNull())
        .distinct()
    )
