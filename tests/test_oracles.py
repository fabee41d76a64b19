import pytest

from helpers import oracle_rows, rows_of
from tallyweave.oracles import ORACLES
from tallyweave.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    names, want = oracle_rows(ORACLES[name], SF)
    assert sorted(df.columns) == names
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["month", "transaction_count", "total_spend"]
    assert set(e.oracle_sql()) <= set(e.queries())
