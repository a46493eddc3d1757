"""Orphans: entities that nothing refers to."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.text import stripped


def referenced(*ends: DataFrame) -> DataFrame:
    """Distinct ids (uuid) among one-column frames of edge ends."""
    return functools.reduce(DataFrame.union, ends).toDF("uuid").where("uuid is not null").distinct()


def orphans(entities: DataFrame, used: DataFrame) -> DataFrame:
    """(uuid, name, prunable, chars) of entities not in use: prunable only if the summary is blank. A null uuid is skipped."""
    free = entities.where(F.col("uuid").isNotNull()).join(used, "uuid", "left_anti")
    text = stripped(F.coalesce("summary", F.lit("")))
    return free.select("uuid", "name", (text == "").alias("prunable"), F.length(text).cast("long").alias("chars"))


def pruned(entities: DataFrame, used: DataFrame, force: bool = False) -> DataFrame:
    """Entities without the prunable orphans; without ``force`` all stay."""
    if not force:
        return entities
    return entities.join(orphans(entities, used).where("prunable").select("uuid"), "uuid", "left_anti").select(*entities.columns)


def prune_counters(planned: DataFrame, entities: DataFrame, used: DataFrame) -> DataFrame:
    """One row on applying a plan (uuid): deleted, skipped as an edge has come since, gone already. used: (uuid)."""
    own = planned.select("uuid").where("uuid is not null").distinct()
    there = own.join(entities.select("uuid").distinct().withColumn("_there", F.lit(True)), "uuid", "left").join(used.withColumn("_used", F.lit(True)), "uuid", "left")
    here = F.col("_there").isNotNull()
    return there.agg(F.count_if(here & F.col("_used").isNull()).alias("deleted"), F.count_if(here & F.col("_used").isNotNull()).alias("skipped"), F.count_if(~here).alias("gone"))
