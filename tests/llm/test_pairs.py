import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import words
from loomgraph.llm import knn, neardup
from loomgraph.llm.components import groups_of
from tests.conftest import rows_of


def union(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    return sorted((top(x), x) for x in up)


def shapes():
    rng = random.Random(5)
    name = lambda i: f"n{rng.randrange(10**6):06}{i}"
    chain = [name(i) for i in range(70)]
    ring, star, tree = ([name(i) for i in range(n)] for n in (9, 30, 40))
    out = [*zip(chain, chain[1:]), *zip(ring, ring[1:] + ring[:1]), *[(star[0], x) for x in star[1:]], *[(tree[i], tree[(i - 1) // 2]) for i in range(1, 40)]]
    clique = [name(i) for i in range(6)]
    out += [(a, b) for a in clique for b in clique] + [("lone", "lone"), (None, "x"), ("y", None), ("p", "q"), ("q", "p"), ("p", "q")]
    sorted_chain = [f"s{i:03}" for i in range(60)]
    return out + list(zip(sorted_chain, sorted_chain[1:]))


@pytest.mark.parametrize("pairs", [shapes(), [(f"{random.Random(s).random():.3f}"[:4], f"{random.Random(-s).random():.3f}"[:4]) for s in range(1, 120)]])
def test_groups_match_union_find(spark, pairs):
    df = spark.createDataFrame(pairs, "x string, y string")
    assert rows_of(groups_of(df, "x", "y")) == union(pairs)


def texts(seed, n=140):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)]
    base = [rng.sample(vocabulary, rng.randrange(1, 14)) for _ in range(20)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((f"u{i:03}", " ".join(w)))
    return [*out, ("e1", ""), ("e2", "!?"), ("e3", None), (None, "w1 w2"), out[0], ("long", " ".join(f"x{i}" for i in range(1500))), ("long2", " ".join(f"x{i}" for i in range(200, 1500)))]


@pytest.mark.parametrize(("long_list", "hot", "share"), [(1000, 20_000, 0.75), (3, 20_000, 0.8), (1, 8, 0.75), (1000, 8, 0.55), (1, 20_000, 0.6)])
def test_alike_pairs_match_brute_force(spark, monkeypatch, long_list, hot, share):
    monkeypatch.setattr(neardup, "LONG_LIST", long_list)
    monkeypatch.setattr(neardup, "HOT_POSTS", hot)
    rows = texts(long_list + hot)
    got = rows_of(neardup.alike_ids(spark.createDataFrame(rows, "id string, t string"), "id", words(F.col("t")), share))
    sets = [(i, frozenset(re.findall("[a-z0-9_]+", (t or "").lower()))) for i, t in rows if i]
    want = {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and len(x & y) >= Fraction(str(share)) * max(len(x), len(y))}
    assert got == sorted(want)


def test_frequent_words_lose_no_link_at_a_low_share(monkeypatch):
    monkeypatch.setattr(neardup, "LONG_LIST", 0)
    words_of = pa.array([[11, 22, 33], [11, 22, 44]], pa.list_(pa.int64()))
    share = neardup.exact_share(0.6)
    kernel = neardup._posts(np.full(neardup.SKETCH, 9), 10, share, 0, min(neardup.MOST_VALUES, neardup.fewest_shared(share)))
    posts = pa.Table.from_batches(list(kernel([pa.record_batch([pa.array([1, 2]), words_of], ["cid", "words"])]))).to_pydict()
    assert {k for k, c in zip(posts["key"], posts["cid"]) if c == 1} & {k for k, c in zip(posts["key"], posts["cid"]) if c == 2}


def test_fewest_shared():
    share = lambda x: neardup.fewest_shared(neardup.exact_share(x))
    assert [share(x) for x in (0.5, 0.55, 0.6, 0.75, 0.8, 0.9)] == [1, 2, 2, 3, 4, 9]
    with pytest.raises(ValueError):
        neardup.exact_share(0)


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(0, 8, n)] + 0.4 * rng.standard_normal((n, 16))).astype(np.float32)
    x[5:9] = x[4]  # copies
    x[20] = x[21] * 4
    return x


def brute(x, k):
    y = x.astype(np.float64)
    y = (y @ y.T) / np.sqrt((y * y).sum(1))[:, None] / np.sqrt((y * y).sum(1))[None]
    np.fill_diagonal(y, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -np.round(y[i], 12)))[:k]}


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_nearest_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    x = vectors(400, 3)
    odd = [(1000, [0.0] * 16), (1001, [float("nan")] + [1.0] * 15), (1002, [1.0] * 15), (1003, None), (1004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (1005, [None] + [1.0] * 15)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd + [(3, x[3].tolist())]
    df = spark.createDataFrame(rows, "result_id long, v array<float>")
    got = {(r["id"], r["other"]) for r in knn.nearest(df, "result_id", "v", 16, 5).collect()}
    want = brute(x, 5)
    assert len(got & want) / len(want) > 0.95 and len(got) <= len(want)
    assert {j for i, j in got if i == 7} == {4, 5, 6, 8, 9} or {4, 5, 6, 8} <= {j for i, j in got if i == 7}


def test_more_copies_than_neighbours(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "i long, v array<float>")
    got = {}
    for r in knn.nearest(df, "i", "v", 2, 10).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert all(got[i] == set([j for j in range(11) if j != i][:10]) for i in range(30))


def test_more_scaled_copies_than_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(16).astype(np.float32)
    scales = rng.permutation(np.arange(-15, 15))
    others = [(100 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((20, 16)).astype(np.float32))]
    df = spark.createDataFrame([(i, (x * np.float32(2.0) ** int(p)).tolist()) for i, p in enumerate(scales)] + others, "i long, v array<float>")
    got = {}
    for r in knn.nearest(df, "i", "v", 16, 10).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert all(got[i] == set([j for j in range(11) if j != i][:10]) for i in range(30))


@pytest.mark.parametrize("held", [1_500_000, 64])
def test_search_ranks_in_double_precision_what_float32_cannot_tell_apart(monkeypatch, held):
    monkeypatch.setattr(knn, "HELD", held)
    monkeypatch.setattr(knn, "CELLS", 120)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    stored = np.nextafter(np.tile(base, (60, 1)).astype(np.float32), np.float32(9) * rng.choice([-1, 1], (60, 16)).astype(np.float32))
    stored[40:] = stored[:20] * np.float32(4)
    ask = (base + 0.3 * rng.standard_normal((25, 16))).astype(np.float32)
    ids = rng.permutation(60)
    plan = knn.HashPlan([np.zeros((16, 2), np.float32)], [np.zeros(2, np.float32)], [], 0)  # one bucket
    row, cid, other, cosine = knn._search(plan, 0, knn._stored(plan, 0, [(ids, stored)]), np.arange(100, 125), ask, 11)
    a, b = ask.astype(np.float64), stored.astype(np.float64)
    exact = (a[:, None] * b[None]).sum(2) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None])
    want = [ids[j] for i in range(25) for j in np.lexsort((ids, -exact[i]))[:11]]
    assert other.tolist() == want and row.tolist() == np.repeat(np.arange(25), 11).tolist() and cid[row[0]] == 100


@pytest.mark.parametrize(("count", "block"), [(400, 1 << 17), (400, 60), (5_000_000, 1 << 17), (5_000_000, 60)])
def test_regions_and_blocks_lose_nothing_that_the_plan_finds(spark, monkeypatch, count, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "PROBES", 4000)
    x = vectors(400, 9)
    near = [x[[j for i2, j in brute(x, 5) if i2 == i]] for i in range(100)]
    plan = knn.plan_of(count, x[:100], near, x, 17)
    assert plan.recall >= 0.97 and (plan.region > 0) == (count > 400)
    got = {(r["id"], r["other"]) for r in knn.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<float>"), "i", "v", 16, 5, plan).collect()}
    want = brute(x, 5)
    assert len(got & want) / len(want) > 0.95


def test_disk_does_not_grow_with_tables_and_probes(spark):
    x = np.random.default_rng(8).standard_normal((3000, 64)).astype(np.float32)
    made = [knn._directions(np.eye(64), np.eye(64), 8, t, 17) for t in range(8)]
    plan = knn.HashPlan([a for a, _ in made], [b for _, b in made], knn.probe_sets(8, 60), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<float>")
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty()
        each = sc.statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before = shuffled()
    knn.nearest(df, "i", "v", 64, 10, plan).write.format("noop").mode("overwrite").save()
    assert shuffled() - before < 2 * x.nbytes


@pytest.mark.parametrize("size", [7, 100, 1000])
def test_blocks_are_all_rows_once(spark, tmp_path, size):
    spark.range(230, numPartitions=3).selectExpr("id cid", "array(cast(id as float), 1f) vec").write.parquet(f"{tmp_path}/t")
    for first, last in ((0, None), (50, 171)):
        parts = list(knn._blocks(f"file://{tmp_path}/t", size, first, last))
        assert [p[0] for p in parts] == list(range(first, last or 230, size)) and np.concatenate([p[1] for p in parts]).tolist() == list(range(first, last or 230))
        assert all(p[1].tolist() == p[2][:, 0].tolist() and len(p[1]) <= size for p in parts)


def test_more_vectors_get_more_functions():
    x = vectors(3000, 4)
    near = [x[[j for i2, j in brute(x[:600], 5) if i2 == i]] for i in range(100)]
    plans = [knn.plan_of(n, x[:100], near, x, 17) for n in (10**3, 10**6, 10**9)]
    parts = [p.compared for p in plans]
    assert parts == sorted(parts, reverse=True) and parts[2] < parts[0] and all(p.recall >= 0.97 for p in plans)


def test_probe_sets_are_in_order_and_valid():
    sets = knn.probe_sets(3, 26)
    assert len(sets) == 26 and len(set(sets)) == 26 and sets[0] == (0,) and all(5 - r not in s for s in sets for r in s)
