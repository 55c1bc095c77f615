"""Every query with an oracle equals DuckDB on the sf0.001 tables (the driver checks sf0.01)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.util import rows

ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.sql(ORACLES[name]).df()
    c1, r1 = rows(got)
    c2, r2 = rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["label", "qty_bin", "n", "avg_price_per_qty", "avg_bal_z", "n_hi_price",
                          "n_low_bal", "avg_price_c", "avg_bal_c"]
