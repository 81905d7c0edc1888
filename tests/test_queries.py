"""Every query against its SQL twin; the others must at least return rows."""

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert len(df.collect()) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"grp", "building", "series_rate"} <= set(rows[0].asDict())
