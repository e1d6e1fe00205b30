import duckdb
import pytest

from rowsmith import catalog
from rowsmith.catalog_text import TEXT

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*TEXT, "update_count", "numbers", "unicode_text", "null_tests", "unnest_function", "agg_of_text", "median", "strict_left_join", "distinct_top"])
def test_query_equals_its_sql(spark, tables, name):
    df, want = catalog.queries()[name](spark, SMALL), tables.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
