"""Queries whose SQL gives one row, over tables in which several rows have the largest or smallest value."""

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Customer 1 has two dearest and two cheapest orders, customer 2 one order, customer 3 equal ones only, customer 4 none."""
    folder = tmp_path_factory.mktemp("tied")
    customers = [(c, f"c{c}", 0, 0.0, "x") for c in (1, 2, 3, 4)]
    prices = [(1, 9.5), (1, 9.5), (1, 2.0), (1, 2.0), (1, 5.0), (2, 7.0), (3, 4.0), (3, 4.0)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(i, c, "O", v, "1") for i, (c, v) in enumerate(prices)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["local_max_min", "min_global", "max_global", "argmax_binding"])
def test_ties_against_sql(spark, tied, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{tied}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, tied)
    cursor = con.execute(entry.oracle_sql()[name])
    assert df.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
