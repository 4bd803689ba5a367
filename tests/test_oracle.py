"""Every registered key against its DuckDB oracle (sf0.001: fast), the way
the driver checks at sf0.01."""

import pytest

import __spark_entry__ as E
from intentlane.plans.registry import all_queries
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = sorted(all_queries())     # the training-data queries have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_key_has_oracle_or_is_listed():
    missing = set(KEYS) - set(E.oracle_sql())
    assert missing <= {"batch_embedding", "vector_topk_approx"}


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, con, key):
    r = compare(spark, key, SF, con)
    if r.get("oracle", "x") is None:
        assert r["spark_rows"] > 0
        return
    assert r["cols_match"], r
    assert r["rows_match"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "event_id" in df.columns
