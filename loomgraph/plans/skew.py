"""Equi-joins whose left side may hold a third of its rows on one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.plans.staging import staged

#: Left rows of one key that a single task may take.
HOT_ROWS = 200_000
#: Hot keys that are broadcast at most; there are at most (left rows / HOT_ROWS) of them.
HOT_KEYS = 500_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with over ``hot_rows`` rows and their number of salts, counted with map-side combining; None if there is none."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = staged(counted.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")), "hot")
    return None if hot.isEmpty() else hot


def small(rows: DataFrame, most: int = HOT_KEYS) -> DataFrame:
    """``rows``, to be broadcast if a count shows at most ``most`` of them; give it a staged table of narrow rows."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread_join(many: DataFrame, once: DataFrame, key: str, how: str = "inner", rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``many`` joined to ``once`` (few rows a key) on ``key``; hot keys of ``many`` are salted and their rows of ``once`` repeated.

    ``rows`` is the row count of ``many`` if it is known: below ``hot_rows`` no key can be hot and nothing is counted.
    Null keys match nothing; with how="left" their rows stay. Every row is kept, whatever its key's frequency.
    """
    if rows is not None and rows <= hot_rows:
        return many.join(once, key, how)
    hot = hot_keys(many, key, hot_rows)
    if hot is None:
        return many.join(once, key, how)
    few = small(hot)
    others = [c for c in many.columns if c != key]
    left = many.join(few, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = once.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
