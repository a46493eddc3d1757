import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import formatting, mixing, subjects, survivor, tokens
from tests.conftest import rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no tokenizers here")

TEXTS = ["", None, " ", "Hello  world", "it's <|endoftext|> done", "日本語 текст naïve 🙂🙂", "tabs\t\t\n\n  end  ", "a" * 5000, "x = {'k': [1, 2]}\r\n" * 200, " nbsp ​ zero", "Hello  world", "١٢٣ ½ ⅷ"]


def test_ids_match_the_tokenizer_and_decode(spark):
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.rank_file()), special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = tokens.encoded(df, "doc_id", "text")
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: coder.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.encoded(df, "doc_id", "text", count_only=True).collect()} == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in tokens.decoded(ids).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_split_tree_is_exact():
    rng = np.random.default_rng(1)
    counts = np.array([7, 0, 1000, 33])
    parts = mixing.split_tree(counts, 13, rng)
    assert (parts.sum(0) == counts).all() and parts.min() >= 0 and np.ptp(parts.sum(1)) <= 1
    assert mixing.split_tree(np.zeros(3, np.int64), 4, rng).sum() == 0


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 5000)
    docs = [(i, ["A-1", "a1 ", "b", "c", "other", None][i % 6], 10 + i % 7) for i in range(3000)] + [(5000, "tiny", 20), (5001, "tiny", None)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    mix = spark.createDataFrame([("a_1", 0.2, 1), ("B", 0.5, 3), ("c", 0.2, 2), ("tiny", 0.05, 4), ("none", 0.05, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mixed(sized, mix).collect()
    total = sum(n or 0 for _, s, n in docs if s in ("A-1", "a1 ", "b", "c", "tiny"))
    held = Counter()
    for r in rows:
        held[r["source"]] += r["n_tokens"] or 0
    assert abs(sum(held.values()) - total) < 100
    assert held["tiny"] == 80 and held["none"] == 0
    rest = total - 80
    for source, share in (("a_1", 0.2), ("B", 0.5), ("c", 0.2)):
        assert abs(held[source] - rest * share / 0.9) < 40
    uses = Counter((r["source"], r["doc_id"]) for r in rows)
    most = {"a_1": 1, "B": 3, "c": 2, "tiny": 4}
    assert all(n <= most[s] for (s, _), n in uses.items())
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    by_shard = Counter(r["shard"] for r in rows)
    assert len(by_shard) > 3 and {(r["shard"], r["position"]) for r in rows} == {(s, p + 1) for s, n in by_shard.items() for p in range(n)}
    shares = {r["source"]: r for r in mixing.shares_reached(mixing.mixed(sized, mix), mix).collect()}
    assert shares["none"]["tokens"] == 0 and abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9


def test_payloads_written_differently(spark):
    rows = [
        ("b", '{"content": "Hello, World 1", "group_id": "g", "name": null, "source_description": "s"}'), ("a", '{"SOURCE_DESCRIPTION":"S","Content":"hello world\\n1!","group_id":"G"}'), ("c", '{"content": "Hello, World 1", "group_id": "g", "name": "n"'),
        ("d", '{"content": "other"}'), ("d", '{"content": "other"}'), ("e", "[1]"), ("f", None), ("g", '{"content": "façade É"}'), ("h", '{"content": "FAÇADE-é"}'), (None, '{"content": "other"}'), ("i", "{}"), ("j", '{"name": "!!"}'), ("k", '{"content": "hell", "group_id": "oworld1"}'),
    ]
    df = spark.createDataFrame(rows, "id string, p string")
    canonical = formatting.canonical_payload(F.col("p"), ["content", "group_id", "name", "source_description"])
    assert rows_of(formatting.formatting_copies(df, "id", canonical)) == [("a", "b"), ("g", "h"), ("i", "j")]
    counts = dict(rows_of(formatting.copy_groups(formatting.fingerprints(df, "id", canonical)).select("first_id", "copies")))
    assert counts == {"a": 2, "d": 2, "g": 2, "i": 2, "k": 1}


def test_collision_is_an_error(spark):
    prints = spark.createDataFrame([("a", b"h", 1, 5, 3), ("b", b"h", 1, 6, 3)], "id string, h binary, x long, z long, n int")
    with pytest.raises(Exception, match="different texts"):
        formatting.copy_groups(prints).collect()


def test_more_repeats_make_fewer_blocks_and_too_many_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 10)
    monkeypatch.setattr(mixing, "USES", 20)
    sized = spark.createDataFrame([(i, "a", 10) for i in range(40)], "doc_id long, source string, n_tokens long")
    mix = lambda n: spark.createDataFrame([("a", 1.0, n)], "source string, target_share double, max_repeats int")
    assert mixing.mixed(sized, mix(10)).count() == 40
    with pytest.raises(ValueError):
        mixing.mixed(sized, mix(21))


def test_too_many_subjects_are_refused(spark, monkeypatch):
    monkeypatch.setattr(subjects, "SUBJECTS", 2)
    areas = spark.createDataFrame([(x,) for x in "abc"], "subject string")
    with pytest.raises(ValueError):
        subjects.classified(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, subject string"), areas)


def test_snapshots(spark):
    snap = {"uuid": "x", "name": "N", "summary": "s"}
    forms = [json.dumps(snap), json.dumps({"NAME": "N"}), json.dumps({"labels": ["E"], "node": snap}), json.dumps(json.dumps(snap)), json.dumps(json.dumps({"properties": snap})), json.dumps(snap)[:-3], "[]", "null", None, "{}", '{"other": {"z": 1}}', '{"name": null}']
    df = spark.createDataFrame(list(enumerate(forms)), "i int, t string")
    assert rows_of(survivor.with_snapshot_fields(df, "t", ["name", "uuid"]).select("i", "name")) == [(0, "N"), (1, "N"), (11, None), (2, "N"), (3, "N"), (4, "N")]


def test_usable(spark):
    values = ["ok", " N/A ", "None", "null", "UNKNOWN", "tbd", "?", "", None, "n/a x", "\ttbd\n"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(survivor.usable(F.col("v")).alias("u")).collect()
    assert [r["u"] for r in got] == [True, False, False, False, False, False, False, False, False, True, False]


def test_subjects_on_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    if not os.path.isdir(at):
        pytest.skip("no larger tables here")
    read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
    names = [r["subject"] for r in read("subject_area").collect()]
    texts, sources, y = subjects.labelled_sample(read("documents"), read("subject_label"), names)
    test = np.arange(len(texts)) % 4 == 0
    pick = lambda xs, m: [x for x, k in zip(xs, m) if k]
    model = subjects.fit(pick(texts, ~test), pick(sources, ~test), y[~test], names)
    parts, structure = [], []
    for t, s in zip(pick(texts, test), pick(sources, test)):
        cut = subjects.sentences_of(t)
        parts.append(subjects.parts_of(model.odds, [[model.terms[x] for x in c if x in model.terms] for c in cut]))
        structure.append(subjects.structure_of(t, s, len(cut)))
    got = subjects.decode(np.array(parts), np.array(structure), model.weights)
    want = y[test][:, [names.index(s) for s in model.subjects]]
    assert 2 * (got & want).sum() / (got.sum() + want.sum()) > 0.9


def test_beam_search_finds_the_best_combination():
    rng = np.random.default_rng(2)
    parts, structure = rng.random((5, 3)), rng.random((5, subjects.SOURCES + len(subjects._STRUCTURE) + 2))
    width = subjects.features_of(parts, structure, 0).shape[1]
    weights = [rng.standard_normal(width + j) for j in range(3)]
    got = subjects.decode(parts, structure, weights, beam=8)
    for i in range(5):
        best = None
        for c in range(8):
            label = np.array([(c >> j) & 1 for j in range(3)], float)
            p = 0.0
            for j, w in enumerate(weights):
                one = subjects._sigmoid(np.concatenate([subjects.features_of(parts, structure, j)[i], label[:j]]) @ w)
                p += np.log(one if label[j] else 1 - one)
            if best is None or p > best[0]:
                best = (p, label)
        assert (got[i] == best[1]).all()
