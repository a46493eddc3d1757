"""Every llm query on tables without rows, of nulls, and with repeats, nulls and clashing columns."""

import pytest

from loomgraph import llm
from tests.conftest import rows_of

QUERIES = {k: f for m in llm.query_modules() for k, f in m.QUERIES.items()}
SAME = ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert all(r["tokens"] == 0 for r in QUERIES[name](spark, empty_dir).collect() if "tokens" in r) if name == "p8_shares" else QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p3_groups", "p4_found", "p5_found", "p6_found", "p8_mix", "p9_found"])
def test_rows_of_nulls(spark, null_dir, name):
    assert QUERIES[name](spark, null_dir).count() == 0


def test_tokens_of_nulls(spark, null_dir):
    assert [tuple(r) for r in QUERIES["p7_ids"](spark, null_dir).collect()] == [(None, [])] * 3


@pytest.mark.parametrize("name", SAME)
def test_repeats_and_clashing_columns(spark, small, wide_dir, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_of(QUERIES[name](spark, wide_dir))


@pytest.mark.parametrize("name", ["p7_ids", "p8_mix", "p9_found"])
def test_clashing_columns_run(spark, wide_dir, name):
    assert QUERIES[name](spark, wide_dir).count() > 0
