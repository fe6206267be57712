"""Every registered query against its SQL statement, at the smallest scale."""

import pytest

from oracle_check import compare, connect
from packaudit.harness.oracle import ORACLE
from packaudit.harness.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_built_in_text_rule_is_hit(spark):
    from packaudit.functions import fixed

    rules = {n for rows in (fixed.TIER1, fixed.TIER2) for n, _ in rows} | {n for n, *_ in fixed.WEIGHTED_INJECTION} | {n for n, _ in fixed.ENCODED_RUNS}
    found = {r.name for r in QUERIES["builtin_tiers_texts"](spark, SF).select("name").distinct().collect()}
    assert rules <= found and "invisible_chars:count=2" in found
