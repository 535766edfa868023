"""Every registered relational query against an independent engine on the smallest tables."""

import duckdb
import pytest
from tidewater.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return f"{v:%Y-%m-%d %H:%M:%S.%f}" if hasattr(v, "hour") else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    other = duck.sql(oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(other.columns), other.fetchall())


def test_subscriptions_of_customers_that_the_transaction_inserts(spark):
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderpriority IN ('1-URGENT', '5-LOW')")
    changed = {str(r[0]) for r in orders.select("o_custkey").distinct().collect()}
    fresh = {str(r[0]) for r in customer.where("c_mktsegment = 'BUILDING'").select("c_custkey").collect()} & changed
    found = {r[0] for r in queries()["prune_search_args"](spark, SF).collect()}
    assert fresh and fresh <= found


def test_entry_without_the_pipeline_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "o_orderkey"
    assert set(oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())
