"""Near-duplicate texts by an inverted join over the coordinates of exact signatures.

The signature of a text is its set of distinct words; a coordinate is a rank in one global order of words, rare words
first, and its value is the word. Two texts are alike if at least ``share`` of the words of either are shared, so
they collide in at least ceil(share * words) coordinates. Of these the rarest two lie in the first
words - ceil(share * words) + 2 coordinates of both (prefix merging): each text is posted under these, collisions are
counted by pair, and pairs that collide there less than twice are dropped (once, where so few words are shared that
the second may be posted with words that aren't). A coordinate-value pair held by many texts is skipped for longer
ones: the next shared word must follow within one more coordinate, so such a text is posted under pairs or triples of
values. Texts that meet pass two exact bounds (length, and the symmetric difference seen through 128-bit parity maps);
what is left has all its collisions counted, and pairs at the threshold are kept. No pair is lost: all tests are
necessary conditions. Sampled (min-hash) signatures would miss pairs; these don't.

Equal word sets are one class: only classes are compared, and their members meet through the class.

The order of words comes from a table of ``SKETCH`` counters over all texts, whose size doesn't depend on the input.
Posting lists over ``HOT_POSTS`` are split into blocks that are joined pair by pair of blocks, in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.plans.skew import small, spread_join
from loomgraph.plans.staging import staged

#: Counters of the word order.
SKETCH = 1 << 16
#: Expected length of a posting list over which a further value joins the key.
LONG_LIST = 1000
#: Values in a key at most, where the share allows so many (see ``fewest_shared``).
MOST_VALUES = 3
#: Posts under one key that one task joins with themselves.
HOT_POSTS = 20_000


def fewest_shared(share: Fraction) -> int:
    """The least number of words that two different word sets share if they are alike.

    Sets of at most n words that differ share n - 1 words or fewer, so n - 1 >= share * n.
    """
    n = -(-1 // (1 - share)) if share < 1 else 1
    return max(1, -(-share * n // 1))


def word_classes(texts: DataFrame, ident: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """Members (id, h) and classes (cid, h, words): a class holds all ids with the same set of words."""
    sets = texts.select(F.col(ident).alias("id"), F.array_sort(words).alias("words")).where(F.col("id").isNotNull())
    marked = sets.withColumn("h", F.unhex(F.md5(F.concat_ws(" ", "words"))))
    members = staged(marked.select("id", "h", "words"), "members")
    classes = staged(members.groupBy("h").agg(F.first("words").alias("words")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    return members.select("id", "h").distinct(), classes


def word_counters(classes: DataFrame) -> np.ndarray:
    """How many classes hold a word, by SKETCH counters: a fixed size, whatever the input's."""
    cells = classes.select(F.explode("words").alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(SKETCH)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    counters = np.zeros(SKETCH, np.int64)
    for row in cells.collect():
        counters[row["c"]] = row["n"]
    return counters


def _posts(counters: np.ndarray, texts: int, share: Fraction, long_list: int, most_values: int):
    """Kernel: (cid, hashes of the words) to posts (key, cid, n, m0, m1)."""

    def keys_of(values: list[int], counts: list[int], prefix: int) -> list[int]:
        """Keys from the first ``prefix`` coordinates, longer ones where few values would make long lists."""
        out, limit = [], len(values)
        for i in range(min(prefix, limit)):
            if counts[i] <= long_list or most_values == 1:
                out.append(values[i])
                continue
            for j in range(i + 1, min(prefix + 1, limit)):
                expected = counts[i] * counts[j] / texts
                two = (values[i] * 3 + values[j] * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF
                if expected <= long_list or most_values == 2:
                    out.append(two)
                    continue
                for k in range(j + 1, min(prefix + 2, limit)):
                    out.append((two * 5 + values[k] * 0xC2B2AE3D27D4EB4F + 2) & 0xFFFFFFFFFFFFFFFF)
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            counts = counters[(flat.view(np.int64) % SKETCH)]
            key, cid, n_of, m0s, m1s = [], [], [], [], []
            for d in range(len(cids)):
                own, seen = flat[at[d] : at[d + 1]], counts[at[d] : at[d + 1]]
                n = len(own)
                if n < 2:
                    continue  # alike only to its own class
                order = np.lexsort((own, seen))
                bit = (own >> np.uint64(20)) & np.uint64(127)
                half = np.left_shift(np.uint64(1), bit & np.uint64(63))
                m0 = np.bitwise_xor.reduce(np.where(bit < 64, half, np.uint64(0)))
                m1 = np.bitwise_xor.reduce(np.where(bit >= 64, half, np.uint64(0)))
                least = -(-share.numerator * n // share.denominator)
                found = keys_of(own[order].tolist(), seen[order].tolist(), n - least + 2)
                key += found
                cid += [cids[d]] * len(found)
                n_of += [n] * len(found)
                m0s += [m0] * len(found)
                m1s += [m1] * len(found)
            yield pa.record_batch(
                [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.array(cid, np.int64)), pa.array(np.array(n_of, np.int32)), pa.array(np.array(m0s, np.uint64).view(np.int64)), pa.array(np.array(m1s, np.uint64).view(np.int64))],
                ["key", "cid", "n", "m0", "m1"],
            )

    return kernel


def _blocks(posts: DataFrame) -> DataFrame:
    """Posts with a cell (x, y): lists of over HOT_POSTS are cut in blocks, each pair of blocks meeting in one cell."""
    cells = posts.groupBy(F.pmod("key", F.lit(SKETCH)).alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_POSTS)
    full = staged(cells.select("c"), "cells")  # at most SKETCH numbers
    if full.isEmpty():
        return posts.withColumns({"x": F.lit(0), "y": F.lit(0), "own": F.lit(0)})
    maybe = posts.join(F.broadcast(full), F.pmod("key", F.lit(SKETCH)) == F.col("c"), "left_semi")
    long = maybe.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_POSTS)
    hot = staged(long.select("key", F.ceil(F.col("n") / HOT_POSTS).cast("int").alias("blocks")), "hot")
    cut = posts.join(small(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = cut.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "other")


def exact_share(share: float | Fraction) -> Fraction:
    """The share as written, so that no rounding of a product loses a pair; it must be above 0 and at most 1."""
    exact = share if isinstance(share, Fraction) else Fraction(str(share))
    if not 0 < exact <= 1:
        raise ValueError("share above 0 and at most 1")
    return exact


def alike_classes(classes: DataFrame, share: float | Fraction) -> DataFrame:
    """Pairs (h_a, h_b) of different classes, each pair once, of which at least ``share`` of the words of either are shared."""
    share = exact_share(share)
    fewest, texts = fewest_shared(share), classes.count()
    values = min(MOST_VALUES, fewest)
    counters = word_counters(classes)
    hashed = classes.select("cid", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    posts = staged(hashed.mapInArrow(_posts(counters, max(texts, 1), share, LONG_LIST, values), "key long, cid long, n int, m0 long, m1 long"), "posts")
    placed = _blocks(posts)
    a, b = placed.alias("a"), placed.alias("b")
    least_of = lambda n: F.ceil(n * F.lit(share.numerator) / F.lit(share.denominator))  # noqa: E731  whole numbers divide exactly
    least = least_of(F.greatest("a.n", "b.n"))
    apart = F.bit_count(F.col("a.m0").bitwiseXOR(F.col("b.m0"))) + F.bit_count(F.col("a.m1").bitwiseXOR(F.col("b.m1")))
    meet = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.cid") < F.col("b.cid"))
        & ((F.col("a.x") == F.col("a.y")) | (F.col("a.own") != F.col("b.own"))) & (F.least("a.n", "b.n") >= least) & (apart <= F.col("a.n") + F.col("b.n") - 2 * least)
    )
    # the second of two shared words may be posted with as many words as a key holds: only then it surely collides
    needed = F.when(least > values, 2).otherwise(1)
    hits = a.join(b.hint("merge"), meet).select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"), needed.alias("needed"))
    met = staged(hits.groupBy("a", "b", "needed").agg(F.count(F.lit(1)).alias("collisions")).where("collisions >= needed").select("a", "b"), "met")
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("h").alias(f"h_{s}"), F.col("words").alias(f"w_{s}"))
    rows = met.count()
    counted = spread_join(spread_join(met, side("a"), "a", "inner", rows), side("b"), "b", "inner", rows)
    shared = F.size(F.array_intersect("w_a", "w_b"))
    return counted.where(shared >= least_of(F.greatest(F.size("w_a"), F.size("w_b")))).select("h_a", "h_b")


def alike_ids(texts: DataFrame, ident: str, words: Column, share: float | Fraction = 0.75) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of different ids whose texts are alike, copies with equal words included.

    A null id is no case; an id with several texts is alike through any of them; repeated rows count once; texts
    without a word are alike to each other only. Empty tables give no pairs.
    """
    members, classes = word_classes(texts, ident, words)
    across = staged(alike_classes(classes, share), "alike")
    members = staged(members, "held")
    several = members.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select(F.col("h").alias("h_a"), F.col("h").alias("h_b"))
    every = across.unionByName(several)
    one = spread_join(members.select("id", F.col("h").alias("h_a")), every, "h_a", "inner", members.count())
    two = spread_join(staged(one, "one"), members.select(F.col("id").alias("id_2"), F.col("h").alias("h_b")), "h_b")
    return two.where(F.col("id") != F.col("id_2")).select(F.least("id", "id_2").alias("id_a"), F.greatest("id", "id_2").alias("id_b")).distinct()


def alike_links(texts: DataFrame, ident: str, words: Column, share: float | Fraction = 0.75) -> tuple[DataFrame, DataFrame]:
    """Members (id, h) and pairs of classes (h_a, h_b): the same likeness without copies expanded."""
    members, classes = word_classes(texts, ident, words)
    return staged(members, "held"), staged(alike_classes(classes, share), "alike")
