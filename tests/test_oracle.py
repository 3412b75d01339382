"""Every registered plan against its DuckDB SQL on the same parquet files (sf0.001), and the
driver entry points."""

import duckdb
import pytest

import __spark_entry__ as E
from strata.sources.readers import TABLES
from tools.check_oracle import close, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["priority_code", "n_orders", "finished_rate", "mean_totalprice"]
    assert df.count() == 5


def test_every_query_has_unique_name_and_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql())))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[name]).fetchdf()
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    bad = [(a, b) for a, b in zip(r1, r2) if not close(a, b)]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() > 0
