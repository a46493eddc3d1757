"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are tokens. Each source's documents fall into blocks by a hash of their id; only block sums reach the driver, at
most ``BLOCKS`` of them and one per source, whatever the corpus. A source's share is met by whole passes over its
blocks and a last, partial pass over blocks in random order, of which the last block is cut between documents. The
uses of blocks are then dealt to output shards: a binary tree splits the exact numbers of uses per source between its
halves by multivariate-hypergeometric draws, so that every shard is a random part of the mix and every use falls in
exactly one shard. Each shard is put in random order by itself.

A source that can't reach its share even with all documents repeated ``max_repeats`` times is used up, and what it
lacks is made up by the others in proportion to their shares, so that the mix keeps its size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.functions.text import key_form
from loomgraph.plans.staging import staged

#: Blocks of all sources together at most, beside one a source; a block has at least BLOCK_TOKENS tokens.
BLOCKS, BLOCK_TOKENS = 1 << 15, 20_000
#: Uses of blocks that the driver deals at most; many repeats make fewer blocks.
USES = 1 << 21
#: Tokens of an output shard; as a block goes to one shard, there are no more shards than blocks.
SHARD_TOKENS = 4_000_000
#: Targets at most: they are held on the driver.
TARGETS = 10_000


class Target(NamedTuple):
    """A source's share of the mix."""

    key: str
    source: str
    share: float
    repeats: int


def targets_of(mix: DataFrame) -> list[Target]:
    """Targets of (source, target_share, max_repeats); sources compare by letters and digits in any letter case.

    Rows without a source, with a share that isn't positive or without repeats take no part; of equal sources the first by name counts.
    """
    rows = mix.select(key_form(F.col("source")).alias("key"), F.col("source").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats")).where("key is not null and share > 0 and repeats > 0").orderBy("key", "source").limit(TARGETS + 1).collect()
    if len(rows) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    return list({t.key: t for t in [Target(*r) for r in reversed(rows)]}.values())


def wanted_tokens(targets: list[Target], held: dict[str, int], total: int) -> dict[str, float]:
    """Tokens of each source in the mix: its share of ``total``, or all it may give; the rest goes to the others in proportion."""
    want, open_ = {t.key: 0.0 for t in targets}, list(targets)
    left = float(total)
    while open_:
        shares = sum(t.share for t in open_)
        full = [t for t in open_ if left * t.share / shares > held.get(t.key, 0) * t.repeats]
        if not full:
            return want | {t.key: left * t.share / shares for t in open_}
        for t in full:
            want[t.key] = float(held.get(t.key, 0) * t.repeats)
        left -= sum(want[t.key] for t in full)
        open_ = [t for t in open_ if t not in full]
    return want


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts (sources) as (shards, sources): exact parts by hypergeometric draws at each node of a binary tree."""
    if shards == 1:
        return counts[None, :]
    first = shards // 2
    part = rng.multivariate_hypergeometric(counts, int(counts.sum()) * first // shards, method="marginals")
    return np.concatenate([split_tree(part, first, rng), split_tree(counts - part, shards - first, rng)])


def mixed(sized: DataFrame, mix: DataFrame, seed: int = 29) -> DataFrame:
    """The mix: (shard, position, doc_id, source, copy, n_tokens), a row per use of a document.

    sized: (doc_id, source, n_tokens), doc_id unique; sources without a target take no part; a document without
    tokens goes with its block. copy counts a document's uses from 0. Without any token the result is empty.
    """
    spark = sized.sparkSession
    targets = targets_of(mix)
    names = spark.createDataFrame([(t.key, i, t.source) for i, t in enumerate(targets)], "key string, s int, source string")
    own = sized.select("doc_id", key_form(F.col("source")).alias("key"), "n_tokens").join(F.broadcast(names), "key").select("doc_id", "s", "source", "n_tokens")  # at most TARGETS rows
    own = staged(own, "sized")
    held = {targets[r["s"]].key: r["n"] or 0 for r in own.groupBy("s").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(held.values())
    repeats = max((t.repeats for t in targets), default=1)
    if repeats > USES:
        raise ValueError(f"more than {USES} repeats")
    most_blocks = min(BLOCKS, USES // repeats)
    block_tokens = max(BLOCK_TOKENS, total // most_blocks)
    cuts = F.element_at(F.array(*[F.lit(max(1, held.get(t.key, 0) // block_tokens)) for t in targets] or [F.lit(1)]), F.col("s") + 1)
    placed = own.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), cuts).cast("int"))
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("s", "block").agg(F.sum("n_tokens").alias("n")).orderBy("s", "block").collect():  # at most BLOCKS + TARGETS
        sums.setdefault(r["s"], []).append((r["block"], r["n"] or 0))

    rng = np.random.default_rng(seed)
    want = wanted_tokens(targets, held, total)
    uses: list[list[tuple[int, int]]] = []  # by source: (block, copy) in random order
    ends: list[tuple[int, int, int, float]] = []  # source, block, copy, tokens: the block that is cut
    for s, t in enumerate(targets):
        blocks = sums.get(s, [])
        passes = min(t.repeats, int(want[t.key] // held[t.key])) if held.get(t.key) else 0
        rest = want[t.key] - passes * held.get(t.key, 0)
        mine = [(b, c) for c in range(passes) for b, _ in blocks]
        for i in rng.permutation(len(blocks)) if passes < t.repeats and rest > 0 else ():
            block, tokens = blocks[i]
            mine.append((block, passes))
            if tokens >= rest:
                ends.append((s, block, passes, rest))
                break
            rest -= tokens
        uses.append([mine[i] for i in rng.permutation(len(mine))])
    shards = int(min(most_blocks, max(1, -(-total // SHARD_TOKENS))))
    quotas = split_tree(np.array([len(u) for u in uses], np.int64), shards, rng) if targets else np.zeros((1, 0), np.int64)
    dealt = []
    for s, mine in enumerate(uses):
        shard_of = np.repeat(np.arange(shards), quotas[:, s])
        dealt += [(s, block, copy, int(shard)) for (block, copy), shard in zip(mine, shard_of)]
    dealt_df = spark.createDataFrame(dealt, "s int, block int, copy int, shard int")
    cut_df = spark.createDataFrame(ends, "s int, block int, copy int, most double")

    # blocks that are cut, at most one a source: documents in random order while they fit
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = placed.join(F.broadcast(cut_df), ["s", "block"]).withColumn("sum", F.sum("n_tokens").over(order)).where("sum <= most").select("doc_id", "s", "block", "source", "n_tokens", "copy")
    small = len(dealt) <= 1_000_000
    plan = F.broadcast(dealt_df) if small else dealt_df
    whole = placed.join(plan, ["s", "block"]).join(F.broadcast(cut_df.drop("most")), ["s", "block", "copy"], "left_anti")
    part = fits.join(plan, ["s", "block", "copy"])
    columns = ["shard", "doc_id", "source", "copy", "n_tokens"]
    every = whole.select(columns).unionByName(part.select(columns))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy"), "doc_id", "copy")
    return every.withColumn("position", F.row_number().over(local)).select("shard", "position", "doc_id", "source", "copy", "n_tokens")


def shares_reached(mix_rows: DataFrame, mix: DataFrame) -> DataFrame:
    """Each target with the tokens, share, documents and most uses of one document that the mix really has."""
    used = mix_rows.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("uses")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    whole = F.sum("tokens").over(Window.partitionBy())  # one row a target
    joined = mix.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["tokens", "documents", "most_uses"])
    return joined.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
