"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare

ORACLES = entry.oracle_sql()
QUICK = [k for k in entry.queries() if k in ORACLES and not k.startswith("op")]  # op*: tests/llm


def test_every_query_named_in_survey_has_a_callable():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 90


@pytest.mark.parametrize("name", QUICK)
def test_matches_oracle(spark, con, name):
    ok, msg = compare(entry.queries()[name](spark, SMALL), con, ORACLES[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "userId", "gender", "churn", "last_level", "days_active", "last_state",
        "avg_songs", "avg_events", "thumbs_up", "thumbs_down", "addfriend",
    ]
    assert df.count() == 13  # two of 15 users drop out: one without plays, one without a place or gender
