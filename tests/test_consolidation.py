import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cluster as C, dedup as D, prune as P
from tests.conftest import rows_of


def graph(spark, edges, alone=()):
    nodes = sorted({x for e in edges for x in e} | set(alone))
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    return n, C.adjacency(spark.createDataFrame([tuple(e) for e in edges], "src string, dst string"), n)


def test_two_edges_swing_and_settle(spark):
    nodes, near = graph(spark, ["ab", "cd"])
    run = C.communities(nodes, near, 0)
    m = C.metrics(run, C.components(nodes, near)).first()
    assert (run.oscillating, m["components"], m["communities"], m["oversized"], run.converged) == (4, 2, 2, False, False)


def test_components_by_size(spark):
    nodes, near = graph(spark, ["ab", "bc", "ef"], "d")
    assert [(r["component"], r["members"]) for r in C.component_sizes(C.components(nodes, near)).collect()] == [("a", 3), ("e", 2), ("d", 1)]
    nodes, near = graph(spark, ["ab", "ac", "ad", "ae", "bc", "cd", "de"], "f")
    assert [r["members"] for r in C.component_sizes(C.components(nodes, near)).collect()] == [5, 1]


def test_empty_graph(spark):
    nodes, near = graph(spark, [])
    run = C.communities(nodes, near)
    assert run.converged and run.labels.count() == 0 and C.components(nodes, near).count() == 0


def propagate(edges, alone, least):
    near = {x: set() for e in edges for x in e} | {x: set() for x in alone}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    free = {x for x in near if len(near[x]) >= least}
    label, seen = {x: x for x in near}, []
    while True:
        seen.append(label)
        new = {}
        for x in near:
            votes = [label[y] for y in near[x] if y in free] if x in free else []
            new[x] = min(set(votes), key=lambda v: (-votes.count(v), v)) if votes else label[x]
        moved = sorted(x for x in near if new[x] != label[x])
        if not moved:
            return new
        label = new
        if new in seen:
            comp = {x: x for x in near}
            for _ in near:
                for x in near:
                    comp[x] = min([comp[x], *[comp[y] for y in near[x]]])
            own = {}
            for x in moved:
                own.setdefault(comp[x], new[x])
            return new | {x: own[comp[x]] for x in moved}


@pytest.mark.parametrize("seed", range(3))
def test_propagation_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [rng.sample("abcdefghijkl", 2) for _ in range(14)]
    nodes, near = graph(spark, ["".join(e) for e in edges], "z")
    want = propagate(edges, "z", 2)
    assert dict(rows_of(C.communities(nodes, near, 2).labels)) == want


def rounds_of(edges, least, most):
    """The states of a whole propagation: labels, rounds, nodes that changed last, and how it ended."""
    near = {x: set() for e in edges for x in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    free = {x for x in near if len(near[x]) >= least}
    label, seen = {x: x for x in near}, []
    for done in range(1, most + 1):
        seen.append(label)
        votes = {x: [label[y] for y in near[x] if y in free] for x in free}
        label = label | {x: min(set(v), key=lambda c, v=v: (-v.count(c), c)) for x, v in votes.items() if v}
        moved = sum(label[x] != seen[-1][x] for x in near)
        if not moved or label in seen:
            return label, done, moved, "same" if not moved else "back"
    return label, done, moved, "cut"


@pytest.mark.parametrize(("within", "most"), [(1 << 19, 1000), (40, 1000), (0, 1000), (40, 5)])
def test_components_followed_by_themselves_give_the_whole_run(spark, within, most):
    rng = random.Random(7)
    edges = [(f"a{i:02}", f"a{i + 1:02}") for i in range(30)] + [(f"b{x}", f"b{y}") for x, y in (rng.sample(range(14), 2) for _ in range(30))] + [(f"c{i}", f"c{i + 1}") for i in range(5)] + [("d1", "d2")]
    nodes, near = graph(spark, edges)
    label, done, moved, end = rounds_of(edges, 2, most)
    run = C.communities(nodes, near, 2, most, within=within)
    assert (run.rounds, run.oscillating, run.converged, run.resolved) == (done, moved, end == "same", end == "back")
    got = dict(rows_of(run.labels))
    assert got == (propagate(edges, "", 2) if end == "back" else label)


def test_long_chains_take_no_job_a_round(spark, monkeypatch):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)]
    nodes, near = graph(spark, edges)
    tables = []
    monkeypatch.setattr(C, "staged", lambda df, name, *instead, real=C.staged: tables.append(name) or real(df, name, *instead))
    run = C.communities(nodes, near, 2)
    assert run.rounds > 90 and len(tables) < 60


def test_partition_hash_ignores_names(spark):
    one = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "node string, label string")
    two = spark.createDataFrame([("c", "x"), ("b", "y"), ("a", "y")], "node string, label string")
    other = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], "node string, label string")
    h = [C.partition_hash(x).first()["partition_hash"] for x in (one, two, other)]
    assert h[0] == h[1] != h[2] and len(h[0]) == 16


def greedy(entities, threshold):
    tokens = {u: set(re.findall("[a-z0-9_]+", (s or "").lower())) for u, _, s, _ in entities}
    score = lambda a, b: 1.0 if not (tokens[a] | tokens[b]) else len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b])
    by, out = {}, set()
    for e in sorted(entities):
        by.setdefault(e[1] or "", []).append(e)
    for rest in by.values():
        while True:
            pairs = [(-score(a[0], b[0]), i, j) for i, a in enumerate(rest) for j, b in enumerate(rest) if i < j]
            if not pairs or -min(pairs)[0] < threshold:
                break
            _, i, j = min(pairs)
            keep, lose = sorted((rest[i], rest[j]), key=lambda e: (-len(e[2] or ""), e[3] or "", e[0]))
            out.add((keep[0], lose[0]))
            rest.remove(lose)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_chain_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    base = [rng.sample(words, 6) for _ in range(3)]
    entities = []
    for i in range(30):
        w = list(rng.choice(base))
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(words)
        entities.append((f"u{i:02}", rng.choice(["n", "m", None, ""]), rng.choice([" ".join(w), " ".join(w), "", None]), rng.choice([None, "2026-01-01", "2026-01-02"])))
    df = spark.createDataFrame(entities, "uuid string, name string, summary string, created_at string")
    got = {(r["survivor_uuid"], r["victim_uuid"]) for r in D.greedy_merges(df, 0.6).collect()}
    assert got == greedy(entities, 0.6)


def test_known_pair_merges_and_unrelated_does_not(spark):
    helper = "The harbour crane log moved from paper slips to the tide_ledger sheet that the night crew keeps."
    again = "The crane log moved from paper slips to the tide_ledger sheet that the night crew keeps."
    df = spark.createDataFrame([("u1", "crane log", helper, "t"), ("u2", "crane log", again, "t"), ("u3", "crane log", "something else", "t")], "uuid string, name string, summary string, created_at string")
    assert rows_of(D.greedy_merges(df, 0.75).select("survivor_uuid", "victim_uuid")) == [("u1", "u2")]


def test_chains_and_rings_of_merges(spark):
    m = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("y", "x"), ("z", "y"), ("x", "z"), ("q", "q")], "survivor_uuid string, victim_uuid string")
    assert rows_of(D.roots(m)) == [("a", "d"), ("b", "d"), ("c", "d"), ("y", "x"), ("z", "x")]


def test_what_leads_into_a_ring_ends_at_its_lowest(spark):
    tail = [(f"t{i + 1:02}", f"t{i:02}") for i in range(20)] + [("v", "t20"), ("w", "v"), ("v", "w")]
    m = spark.createDataFrame(tail, "survivor_uuid string, victim_uuid string")
    assert rows_of(D.roots(m)) == sorted([(f"t{i:02}", "v") for i in range(21)] + [("w", "v")])


def test_relations_move_and_count(spark):
    r = spark.createDataFrame([("r1", "u1", "u2", "f", "1"), ("r2", "u2", "u1", "f", "1"), ("r3", "x", "u1", "f", "2"), ("r4", "x", "u2", "f", "1"), ("r5", "x", "u2", None, "1"), ("r6", "p", "q", "f", "1"), ("r7", "p", "q", "f", "2"), ("r8", "p", "p", "f", "1"), ("r9", "u1", "u2", "g", "1")], "uuid string, src_uuid string, dst_uuid string, fact string, created_at string").withColumn("extra", F.lit(7))
    moves = spark.createDataFrame([("u2", "u1")], "victim string, root string")
    assert rows_of(D.relation_counters(r, moves)) == [(2, 3, 2)]
    kept = D.apply_relations(r, moves)
    assert kept.columns == r.columns and rows_of(kept.select("uuid", "src_uuid", "dst_uuid")) == [("r3", "x", "u1"), ("r5", "x", "u1"), ("r6", "p", "q"), ("r7", "p", "q"), ("r8", "p", "p")]
    assert rows_of(D.apply_relations(r, moves, touched_only=False).select("uuid")) == [("r3",), ("r5",), ("r6",), ("r8",)]


def test_low_similarities_are_reported(spark):
    e = spark.createDataFrame([("a", "n", " ".join(f"w{i}" for i in range(20)), "1"), ("b", "n", "w1 x1 x2 x3 x4 x5 x6 x7 x8 x9", "1"), ("c", "m", "y", "1")], "uuid string, name string, summary string, created_at string")
    assert D.highest_similarity(D.word_sets(e)).first()[0] == round(1 / 29, 4)
    assert D.highest_similarity(D.word_sets(e.where("uuid != 'b'"))).first()[0] == 0


def test_edgeless_folds_may_be_refused(spark):
    folds = spark.createDataFrame([("n", "a", "b")], "name string, survivor_uuid string, victim_uuid string")
    some = lambda x: spark.createDataFrame([(x,)], "src_uuid string")
    assert [D.foldable(folds, some(x), e).count() for x, e in (("b", False), ("z", False), ("z", True))] == [1, 0, 1]


def test_prune_counters(spark):
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "uuid string")
    assert rows_of(P.prune_counters(ids("abcd"), ids("abcx"), ids("bx"))) == [(2, 1, 1)]


def test_apply_moves_and_drops_only_made_doubles(spark):
    e = spark.createDataFrame([("u1", "n", "s", "t", "g"), ("u2", "n", "s", "t", "g")], "uuid string, name string, summary string, created_at string, group_id string")
    m = spark.createDataFrame([("m1", "e1", "u2", "1"), ("m2", "e1", "u1", "2"), ("m3", "e2", "u1", "1"), ("m4", "e2", "u1", "2")], "uuid string, src_uuid string, dst_uuid string, created_at string")
    merges = spark.createDataFrame([("u1", "u2")], "survivor_uuid string, victim_uuid string")
    entities, mentions, _ = D.apply_merges(e, m, merges)
    assert rows_of(entities.select("uuid")) == [("u1",)]
    assert rows_of(mentions.select("uuid", "dst_uuid")) == [("m2", "u1"), ("m3", "u1"), ("m4", "u1")]
    assert D.collisions(D.redirected(m, D.roots(merges), ["dst_uuid"]), ["src_uuid", "dst_uuid"]).first()["drops"] == 1


def test_exact_folds(spark):
    e = spark.createDataFrame([("u2", "s", "x", "1"), ("u1", "s", "x", "1"), ("u3", "t", "x", "0"), ("", "s", "x", "0"), (None, "s", "x", "0"), ("u4", None, None, None), ("u5", None, None, None)], "uuid string, name string, content string, created_at string")
    assert rows_of(D.exact_folds(e).select("survivor_uuid", "victim_uuid")) == [("u1", "u2"), ("u4", "u5")]


def test_orphans(spark):
    e = spark.createDataFrame([("a", "n", "text"), ("b", "n", " \t "), ("c", "n", None), ("d", "n", None), (None, "n", None)], "uuid string, name string, summary string")
    used = P.referenced(spark.createDataFrame([("d",), (None,)], "x string"))
    assert rows_of(P.orphans(e, used).select("uuid", "prunable", "chars")) == [("a", False, 4), ("b", True, 0), ("c", True, 0)]
    assert P.pruned(e, used).count() == 5 and rows_of(P.pruned(e, used, True).select(F.coalesce("uuid", F.lit("-")))) == [("-",), ("a",), ("d",)]


def test_threshold_and_report():
    assert [D.threshold_of(x) for x in (0.5, 1, 2, "x", True, None)] == [0.5, 1.0, 0.8, 0.8, 0.8, 0.8]
    assert D.report_text(0, 0.8, 0.7778) == "0 mergeable pairs at threshold 0.80; max observed similarity 0.7778"
