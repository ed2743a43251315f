import duckdb
import pytest

import __spark_entry__ as entry
from kvlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.queries())
def test_equals_duckdb(spark, duck, name):
    found, expected = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    plain = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(found).equals(plain(expected))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
