"""One query for every operator, over the sample tables, with the SQL an independent engine checks it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import functions as V
from tidewater.engine import Database
from tidewater.errors import ConstraintProblem
from tidewater.operators import builder, delta, index, workloads
from tidewater.plans import security
from tidewater.plans.catalog import Catalog
from tidewater.plans.logical import bind
from tidewater.plans.types import BYTES, IDENTITY, U32, U64, Type
from tidewater.sources import sinks
from tidewater.sources.files import shared_dir
from tidewater.sources.parquet import sample_catalog
from tidewater.streaming import live, log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a database over the sample tables."""

    def add(f: Callable[[Database], DataFrame]) -> Callable[[Database], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Database(sample_catalog(spark, sf_dir)))
        if sql:
            _SQL[name] = sql
        return f

    return add


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a SELECT of the engine; the other engine runs the same text unless its own is given."""
    query(name, oracle or sql)(lambda db: db.sql(sql))


# -- scans

statement("scan_all", "SELECT * FROM customer")
statement("scan_lineitem", "SELECT * FROM lineitem")
statement("table_count", "SELECT count(*) AS n FROM lineitem")


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def _(db: Database) -> DataFrame:
    return index.by_index(db.catalog, "orders", ("o_orderkey",), 77)


@query("point_lookup_multi", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 3")
def _(db: Database) -> DataFrame:
    return index.by_index(db.catalog, "lineitem", ("l_returnflag", "l_linestatus", "l_linenumber"), "R", "F", 3)


for _name, _range, _where in (
    ("range_incl_incl", index.Range(index.included(10), index.included(60)), "BETWEEN 10 AND 60"),
    ("range_incl_excl", index.Range(index.included(10), index.excluded(60)), ">= 10 AND o_custkey < 60"),
    ("range_from", index.Range(index.excluded(100)), "> 100"),
    ("range_to", index.Range(index.UNBOUNDED, index.included(40)), "<= 40"),
):
    query(_name, f"SELECT * FROM orders WHERE o_custkey {_where}")(lambda db, r=_range: index.by_index(db.catalog, "orders", ("o_custkey",), r))


@query("prefix_scan", "SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'")
def _(db: Database) -> DataFrame:
    return index.by_index(db.catalog, "lineitem", ("l_returnflag", "l_linestatus", "l_linenumber"), "A", "O")


@query("prefix_range_scan", "SELECT * FROM orders WHERE o_custkey = 7 AND o_totalprice >= 1000 AND o_totalprice < 200000")
def _(db: Database) -> DataFrame:
    return index.by_index(db.catalog, "orders", ("o_custkey", "o_totalprice"), 7, index.Range(index.included(1000.0), index.excluded(200000.0)))


@query("col_eq", "SELECT * FROM part WHERE p_size = 7")
def _(db: Database) -> DataFrame:
    return index.by_column(db.catalog.frames["part"], "p_size", 7)


@query("col_range", "SELECT * FROM part WHERE p_size > 7 AND p_size <= 20")
def _(db: Database) -> DataFrame:
    return index.by_column(db.catalog.frames["part"], "p_size", index.Range(index.excluded(7), index.included(20)))


@query("unique_find", "SELECT * FROM customer WHERE c_custkey = 42")
def _(db: Database) -> DataFrame:
    return index.find(db.catalog, "customer", "c_custkey", 42)


@query("subscribe_all_counts", "SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def _(db: Database) -> DataFrame:
    rows = live.Subscriptions(db.catalog).subscribe_all()
    return live.union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, (_, df) in rows.items()])


@query("system_tables", "SELECT 'region' AS table_name, 2 AS n UNION ALL SELECT 'nation', 3 UNION ALL SELECT 'customer', 5 UNION ALL SELECT 'supplier', 4 UNION ALL SELECT 'part', 6 UNION ALL SELECT 'orders', 6 UNION ALL SELECT 'lineitem', 11 UNION ALL SELECT 'events', 6 UNION ALL SELECT 'documents', 5")
def _(db: Database) -> DataFrame:
    return db.catalog.system_tables()["st_column"].groupBy("table_name").agg(F.count(F.lit(1)).cast("int").alias("n"))


# -- projections and filters

statement("project_cols", "SELECT o_orderkey, o_custkey FROM orders")
statement("project_alias", "SELECT c_custkey AS id, c_name AS name FROM customer")
statement("filter_eq", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
statement("filter_ne", "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
statement("filter_lt", "SELECT * FROM part WHERE p_size < 10")
statement("filter_lte", "SELECT * FROM part WHERE p_size <= 10")
statement("filter_gt", "SELECT * FROM orders WHERE o_totalprice > 200000")
statement("filter_gte", "SELECT * FROM lineitem WHERE l_quantity >= 49")
statement("filter_lit_left", "SELECT * FROM part WHERE 40 < p_size")
statement("filter_col_col", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = l_partkey")
statement("filter_bool_const", "SELECT * FROM nation WHERE true = true")
statement("filter_true", "SELECT * FROM region WHERE true")
statement("filter_and", "SELECT * FROM part WHERE p_size = 7 AND p_retailprice > 902")
statement("filter_or", "SELECT * FROM part WHERE p_size = 7 OR p_size = 9")
statement("filter_nested", "SELECT * FROM part WHERE (p_size = 7 OR p_size = 9) AND (p_retailprice > 1000 OR p_brand = 'Brand#13')")
statement("filter_negative", "SELECT * FROM customer WHERE c_acctbal < -500.5")
statement("lit_sci", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 1e3 AND o_totalprice < 1.5E5")
statement("lit_ts", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1995-01-01T00:00:00Z' AND o_orderdate < '1997-06-01 02:00:00+02:00'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-06-01 00:00:00'")


def _with_identity(db: Database) -> Catalog:
    """customer with an identity and bytes made of its key; orders as it is."""
    c = db.catalog.frames["customer"]
    hexed = F.lpad(F.hex("c_custkey"), 64, "0")
    db.catalog.add("member", c.withColumn("identity", F.unhex(hexed)).withColumn("tag", F.unhex(F.lpad(F.hex("c_custkey"), 4, "0"))), {"identity": IDENTITY, "tag": BYTES}, primary_key="c_custkey")
    db.catalog.add("owned", db.catalog.frames["orders"].withColumn("identity", F.unhex(F.lpad(F.hex("o_custkey"), 64, "0"))), {"identity": IDENTITY}, primary_key="o_orderkey")
    return db.catalog


def caller(key: int) -> bytes:
    return key.to_bytes(32, "big")


@query("lit_hex", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 171 OR c_custkey = 300")
def _(db: Database) -> DataFrame:
    _with_identity(db)
    return db.sql("SELECT c_custkey, c_name FROM member WHERE tag = 0x00AB OR tag = X'012C'")


@query("param_sender", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 17")
def _(db: Database) -> DataFrame:
    _with_identity(db)
    return db.sql("SELECT c_custkey, c_name FROM member WHERE identity = :sender", caller(17))


@query("view_per_sender", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 17")
def _(db: Database) -> DataFrame:
    _with_identity(db)
    rows = live.sender_view(db.catalog.frames["owned"].select("identity", "o_orderkey", "o_custkey", "o_totalprice"), "identity").drop("identity")
    db.catalog.add("my_orders", rows, view=True, per_sender=True)
    return db.sql("SELECT * FROM my_orders", caller(17))


# -- joins

statement("join_inner_2", "SELECT o.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
statement("join_inner_3", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_orderdate, c.c_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND l.l_returnflag = 'R'")
statement("join_inner_4", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'")
statement("join_cross", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r")
statement("join_no_on", "SELECT count(*) AS n FROM nation n JOIN supplier s", "SELECT count(*) AS n FROM nation n CROSS JOIN supplier s")
statement("join_theta", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r WHERE n.n_regionkey < r.r_regionkey")
statement("join_self", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
statement("join_unique_key", "SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size = 1")
statement("join_project_left", "SELECT s.* FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 1")
statement("join_project_right", "SELECT n.* FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
statement("semijoin_bag_left", "SELECT c.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
statement("semijoin_bag_right", "SELECT o.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 9000")


@query("qb_left_semijoin", "SELECT c.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'MACHINERY'")
def _(db: Database) -> DataFrame:
    c, o = (builder.table(db.catalog, n) for n in ("customer", "orders"))
    return c.where(lambda t: t.c_mktsegment.eq("MACHINERY")).left_semijoin(o, lambda a, b: (a.c_custkey, b.o_custkey)).frame()


@query("qb_right_semijoin", "SELECT o.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 5000 AND o.o_totalprice > 100000")
def _(db: Database) -> DataFrame:
    c, o = (builder.table(db.catalog, n) for n in ("customer", "orders"))
    return c.where(lambda t: t.c_acctbal.gt(5000)).right_semijoin(o, lambda a, b: (a.c_custkey, b.o_custkey)).where(lambda t: t.o_totalprice.gt(100000)).frame()


@query("qb_semijoin_filter_first", "SELECT o.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 8000 AND o.o_totalprice > 50000")
def _(db: Database) -> DataFrame:
    c, o = (builder.table(db.catalog, n) for n in ("customer", "orders"))
    found = o.where(lambda t: t.o_totalprice.gt(50000)).left_semijoin(c.where(lambda t: t.c_acctbal.gt(8000)), lambda a, b: (a.o_custkey, b.c_custkey), filter_first=True)
    assert found.sql.index('"customer" JOIN "orders"') < found.sql.index('"c_acctbal" >') < found.sql.index('"o_totalprice" >')
    return found.frame()


@query("qb_filter", "SELECT * FROM part WHERE (p_size >= 10 AND p_size <= 12) OR p_brand = 'Brand#13'")
def _(db: Database) -> DataFrame:
    return builder.table(db.catalog, "part").where(lambda t: t.p_size.gte(10).and_(t.p_size.lte(12)).or_(t.p_brand.eq("Brand#13"))).frame()


# -- counts and limits

statement("count_star", "SELECT count(*) AS n FROM orders")
statement("count_filter", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10")
statement("count_join", "SELECT count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'")
statement("count_empty", "SELECT count(*) AS n FROM region WHERE r_regionkey = 99")
statement("count_limit", "SELECT count(*) AS n FROM region LIMIT 1")
statement("limit_zero", "SELECT * FROM nation LIMIT 0")
statement("limit_over", "SELECT * FROM nation LIMIT 1000000")


@query("limit_n", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 37) q")
def _(db: Database) -> DataFrame:
    return db.sql("SELECT * FROM orders LIMIT 37").agg(F.count(F.lit(1)).alias("n"))


@query("ndv_exact", "SELECT count(DISTINCT o_custkey) AS keys FROM orders")
def _(db: Database) -> DataFrame:
    return index.distinct_keys(db.catalog.frames["orders"], ("o_custkey",))


# -- changes by SQL


def changed(name: str, table: str, sql: str, oracle: str, prepare: Callable[[Database], object] | None = None) -> None:
    def run(db: Database) -> DataFrame:
        if prepare:
            prepare(db)
        db.change(sql)
        return db.catalog.frames[table]

    query(name, oracle)(run)


changed("dml_insert", "region", "INSERT INTO region (r_regionkey, r_name) VALUES (7, 'ATLANTIS'), (8, 'MU'), (7, 'ATLANTIS')", "SELECT * FROM region UNION ALL SELECT 7, 'ATLANTIS' UNION ALL SELECT 8, 'MU'")
changed("dml_delete", "orders", "DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")
changed("dml_delete_all", "region", "DELETE FROM region", "SELECT * FROM region WHERE false")
changed("dml_delete_by_key", "customer", "DELETE FROM customer WHERE c_custkey = 5", "SELECT * FROM customer WHERE c_custkey <> 5")
changed("dml_update", "part", "UPDATE part SET p_size = 99, p_brand = 'none' WHERE p_size < 5", "SELECT p_partkey, p_name, CASE WHEN p_size < 5 THEN 'none' ELSE p_brand END AS p_brand, p_type, CASE WHEN p_size < 5 THEN 99 ELSE p_size END::INTEGER AS p_size, p_retailprice FROM part")
# with its key the table would refuse it
changed("dml_update_all", "nation", "UPDATE nation SET n_name = 'x', n_nationkey = 1", "SELECT DISTINCT 1::INTEGER AS n_nationkey, 'x' AS n_name, n_regionkey FROM nation", prepare=lambda db: db.catalog.add("nation", db.catalog.frames["nation"]))


@query("dml_metrics", "SELECT count(*) AS matched FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(db: Database) -> DataFrame:
    found = db.change("DELETE FROM orders WHERE o_orderpriority = '1-URGENT'").metrics()
    return db.catalog.spark.createDataFrame([(found["deleted"],)], "matched bigint")


@query("dml_metrics_all", "SELECT 'insert' AS verb, 1::BIGINT AS inserted, 0::BIGINT AS deleted, 0::BIGINT AS updated UNION ALL SELECT 'update', 0, 0, (SELECT count(*) FROM part WHERE p_size < 9) UNION ALL SELECT 'delete', 0, 1 + (SELECT count(*) FROM part WHERE p_size >= 45), 0")
def _(db: Database) -> DataFrame:
    part = db.catalog.frames["part"]
    db.catalog.add("part", part.select("p_partkey", "p_size"), primary_key="p_partkey")
    done = {
        "insert": db.change("INSERT INTO part VALUES (-1, 50), (-1, 50)"),
        "update": db.change("UPDATE part SET p_size = 8 WHERE p_size < 9"),
        "delete": db.change("DELETE FROM part WHERE p_size >= 45"),
    }
    found = {k: {"inserted": 0, "deleted": 0, "updated": 0} | c.metrics() for k, c in done.items()}
    return db.catalog.spark.createDataFrame([(k, m["inserted"], m["deleted"], m["updated"]) for k, m in found.items()], "verb string, inserted bigint, deleted bigint, updated bigint")


_GAPS = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang FROM documents"


@query("dml_delete_null", f"SELECT * FROM ({_GAPS}) d WHERE lang IS DISTINCT FROM 'de'")
def _(db: Database) -> DataFrame:
    gaps = db.catalog.frames["documents"].select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    db.catalog.add("d", gaps, primary_key="doc_id")
    db.change("DELETE FROM d WHERE lang = 'de'")
    return db.catalog.frames["d"]


@query("dml_unique", "SELECT *, 3 AS refused FROM region")
def _(db: Database) -> DataFrame:
    refused = 0
    for sql in ("INSERT INTO region VALUES (1, 'OTHER')", "INSERT INTO region VALUES (8, 'A'), (8, 'B')", "UPDATE region SET r_regionkey = 2 WHERE r_name = 'ASIA' OR r_name = 'EUROPE'"):
        try:
            db.change(sql)
        except ConstraintProblem:
            refused += 1
    return db.catalog.frames["region"].withColumn("refused", F.lit(refused))


@query("dml_many", "SELECT c_custkey, CASE WHEN c_custkey <= 11 THEN 'early' ELSE c_name END AS c_name FROM customer WHERE c_custkey <> 3 AND c_custkey <> 8 UNION ALL SELECT -k, 'new' FROM range(1, 8) t(k)")
def _(db: Database) -> DataFrame:
    """More statements than are stacked before the table's change is written."""
    db.catalog.add("c", db.catalog.frames["customer"].select("c_custkey", "c_name"), primary_key="c_custkey")
    for k in range(1, 8):
        db.change(f"INSERT INTO c VALUES (-{k}, 'new')")
    for k in (3, 8):
        db.change(f"DELETE FROM c WHERE c_custkey = {k}")
    db.change("UPDATE c SET c_name = 'early' WHERE c_custkey <= 11 AND c_custkey >= 0")
    return db.catalog.frames["c"]


@query("show_row_limit", "SELECT 500::BIGINT AS row_limit")
def _(db: Database) -> DataFrame:
    db.sql("SET row_limit = 500")
    return db.sql("SHOW row_limit")


# -- live queries. Before the transaction the tables lack the rows it inserts and hold those it deletes.

_ORDERS = ("o_orderpriority = '1-URGENT'", "o_orderpriority = '5-LOW'")
_CUSTOMERS = ("c_mktsegment = 'BUILDING'", "c_mktsegment = 'MACHINERY'")
_BEFORE = f"o0 AS (SELECT * FROM orders WHERE NOT {_ORDERS[0]}), c0 AS (SELECT * FROM customer WHERE NOT {_CUSTOMERS[0]})"
_AFTER = f"o1 AS (SELECT * FROM orders WHERE NOT {_ORDERS[1]}), c1 AS (SELECT * FROM customer WHERE NOT {_CUSTOMERS[1]})"
_JOIN = "SELECT c.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"


def transaction(db: Database) -> dict[str, DataFrame]:
    """Deltas of orders and customer; the catalogue then holds the states before."""
    deltas = {}
    for name, (came, gone) in (("orders", _ORDERS), ("customer", _CUSTOMERS)):
        frame = db.catalog.frames[name]
        deltas[name] = delta.weighted(frame.where(came), frame.where(gone))
        db.catalog.put(name, frame.where(f"NOT {came}"))
    return deltas


def change_of(db: Database, sql: str) -> DataFrame:
    deltas = transaction(db)
    found = bind(db.catalog, sql)
    delta.check(db.catalog, found)
    return delta.change(db.catalog, found, deltas, before=True)


def _old_new(body: str) -> tuple[str, str]:
    return body.replace("orders", "o0").replace("customer", "c0"), body.replace("orders", "o1").replace("customer", "c1")


def _difference(body: str, came: bool) -> str:
    old, new = _old_new(body)
    a, b = (new, old) if came else (old, new)
    return f"WITH {_BEFORE}, {_AFTER} ({a}) EXCEPT ALL ({b})"


query("delta_scan_ins", f"SELECT * FROM orders WHERE {_ORDERS[0]}")(lambda db: delta.inserted(transaction(db)["orders"]))
query("delta_scan_del", f"SELECT * FROM orders WHERE {_ORDERS[1]}")(lambda db: delta.deleted(transaction(db)["orders"]))


@query("delta_index_scan", f"SELECT *, CASE WHEN {_ORDERS[0]} THEN 1 ELSE -1 END::BIGINT AS _w FROM orders WHERE ({_ORDERS[0]} OR {_ORDERS[1]}) AND o_custkey BETWEEN 10 AND 60")
def _(db: Database) -> DataFrame:
    """A range of an index over the rows that a transaction changed."""
    return index.scan(transaction(db)["orders"], ("o_custkey",), index.Range(index.included(10), index.included(60)))


@query("read_your_writes", f"SELECT * FROM orders WHERE NOT {_ORDERS[1]}")
def _(db: Database) -> DataFrame:
    d = transaction(db)["orders"]
    return index.read_your_writes(db.catalog.frames["orders"], delta.inserted(d), delta.deleted(d))


@query("sub_initial", "SELECT * FROM customer WHERE c_acctbal > 0")
def _(db: Database) -> DataFrame:
    return live.Subscriptions(db.catalog).subscribe("SELECT * FROM customer WHERE c_acctbal > 0")[1]


@query("unsubscribe_rows", "SELECT *, 'delete' AS _op FROM customer WHERE c_acctbal > 0")
def _(db: Database) -> DataFrame:
    s = live.Subscriptions(db.catalog)
    return s.unsubscribe(s.subscribe("SELECT * FROM customer WHERE c_acctbal > 0")[0])


_FILTER = "SELECT * FROM orders WHERE o_totalprice > 100000"
query("ivm_filter_ins", _difference(_FILTER, True))(lambda db: delta.inserted(change_of(db, _FILTER)))
query("ivm_filter_del", _difference(_FILTER, False))(lambda db: delta.deleted(change_of(db, _FILTER)))
_RIGHT = "SELECT o.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0"
query("ivm_join_ins", _difference(_RIGHT, True))(lambda db: delta.inserted(change_of(db, _RIGHT)))
query("ivm_join_del", _difference(_RIGHT, False))(lambda db: delta.deleted(change_of(db, _RIGHT)))
query("ivm_join_bag", _difference(_JOIN, True))(lambda db: delta.inserted(change_of(db, _JOIN)))
query("ivm_join_bag_del", _difference(_JOIN, False))(lambda db: delta.deleted(change_of(db, _JOIN)))
_OLD, _NEW = _old_new(_JOIN)


@query("cache_apply", f"WITH {_BEFORE}, {_AFTER}, a AS (SELECT DISTINCT * FROM ({_OLD})), b AS (SELECT DISTINCT * FROM ({_NEW})) SELECT *, 'insert' AS _op FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'delete' AS _op FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _(db: Database) -> DataFrame:
    deltas = transaction(db)
    before = db.sql(_JOIN)
    s = live.Subscriptions(db.catalog)
    key, _ = s.subscribe(_JOIN)
    return delta.cache_changes(before, s.apply(deltas)[key])


@query("cache_updates", "SELECT p_partkey AS key, CASE WHEN p_size < 5 THEN 'update' WHEN p_size > 48 THEN 'insert' ELSE 'delete' END AS _op, CASE WHEN p_size > 48 THEN NULL ELSE p_size END AS old_size, CASE WHEN p_size < 5 THEN p_size + 100 WHEN p_size > 48 THEN p_size ELSE NULL END AS new_size FROM part WHERE p_size < 5 OR p_size = 7 OR p_size > 48")
def _(db: Database) -> DataFrame:
    p = db.catalog.frames["part"]
    deletes = p.where("p_size < 5 OR p_size = 7")
    inserts = p.where("p_size < 5").withColumn("p_size", F.col("p_size") + 100).unionByName(p.where("p_size > 48"))
    return delta.updates(inserts, deletes, "p_partkey").select("key", "_op", F.col("old.p_size").alias("old_size"), F.col("new.p_size").alias("new_size"))


@query("multi_sub_overlap", "SELECT * FROM part WHERE p_size < 10 OR p_retailprice > 1200")
def _(db: Database) -> DataFrame:
    return db.cached(["SELECT * FROM part WHERE p_size < 10", "SELECT * FROM part WHERE p_retailprice > 1200"])


@query("event_inserts", "SELECT * FROM events WHERE event_type = 'click'")
def _(db: Database) -> DataFrame:
    rows = db.catalog.frames["events"]
    s = live.Subscriptions(db.catalog)
    key, _ = s.subscribe("SELECT * FROM events WHERE event_type = 'click'")
    return delta.inserted(s.apply({"events": delta.weighted(rows, rows.limit(0))})[key])


@query("prune_search_args", f"SELECT DISTINCT o_custkey::VARCHAR AS query_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_ORDERS[0]} OR {_ORDERS[1]}")
def _(db: Database) -> DataFrame:
    """A subscription to each customer's orders, also of those that the transaction inserts: those that it concerns."""
    key = F.col("c_custkey").cast("string")
    asked = db.catalog.frames["customer"].select(key.alias("query_id"), F.lit("o_custkey").alias("column"), key.alias("value"))
    return live.pruned_by_value(transaction(db)["orders"], asked)


@query("prune_join_edge", f"SELECT DISTINCT c_nationkey::VARCHAR AS query_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE {_ORDERS[0]} OR {_ORDERS[1]}")
def _(db: Database) -> DataFrame:
    orders, customer = db.catalog.frames["orders"], db.catalog.frames["customer"]
    changes = delta.weighted(orders.where(_ORDERS[0]), orders.where(_ORDERS[1]))
    asked = db.catalog.spark.range(25).select(F.col("id").cast("string").alias("query_id"), F.col("id").cast("string").alias("value"))
    return live.pruned_by_edge(changes, "o_custkey", customer, "c_custkey", "c_nationkey", asked)


@query("replay_as_of", "SELECT * FROM part WHERE p_size <= 30 AND NOT (p_size < 10)")
def _(db: Database) -> DataFrame:
    p = db.catalog.frames["part"]
    none = p.limit(0)
    entries = [log.entries(1, p.where("p_size <= 20"), none), log.entries(2, p.where("p_size > 20 AND p_size <= 30"), p.where("p_size < 10")), log.entries(3, p.where("p_size > 30"), p.where("p_size = 15"))]
    return log.replay(live.union(entries), as_of=2)


@query("view_query", "SELECT * FROM supplier WHERE s_acctbal > 5000")
def _(db: Database) -> DataFrame:
    db.catalog.add_view("rich_suppliers", builder.table(db.catalog, "supplier").where(lambda t: t.s_acctbal.gt(5000)).sql)
    return db.sql("SELECT * FROM rich_suppliers")


@query("view_query_live", f"SELECT *, 1::BIGINT AS _w FROM customer WHERE {_CUSTOMERS[0]} AND c_acctbal > 0 UNION ALL SELECT *, -1 FROM customer WHERE {_CUSTOMERS[1]} AND c_acctbal > 0")
def _(db: Database) -> DataFrame:
    """What a subscription to a query view sees of a transaction."""
    deltas = transaction(db)
    db.catalog.add_view("solvent", "SELECT * FROM customer WHERE c_acctbal > 0")
    s = live.Subscriptions(db.catalog)
    key, _ = s.subscribe("SELECT * FROM solvent")
    return s.apply(deltas)[key]


@query("view_recompute", f"SELECT o_custkey, count(*) AS n FROM orders WHERE NOT {_ORDERS[1]} GROUP BY o_custkey")
def _(db: Database) -> DataFrame:
    deltas = transaction(db)
    db.catalog.add_view("order_counts", procedure=lambda read: read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
    live.Subscriptions(db.catalog).apply(deltas)  # it reads orders, which change
    return db.sql("SELECT * FROM order_counts")


# -- what changes nothing, transactions in one pass, pruned queries, a stream that is started again


@query("ivm_noop", "SELECT *, 1::BIGINT AS _w FROM part WHERE p_size = 3 UNION ALL SELECT *, -1 FROM part WHERE p_size = 4")
def _(db: Database) -> DataFrame:
    """Rows that come again and rows that go without having been there are no change."""
    p = db.catalog.frames["part"]
    db.catalog.put("part", p.where("p_size NOT IN (3, 5)"))
    s = live.Subscriptions(db.catalog)
    key, _ = s.subscribe("SELECT * FROM part")
    quiet, _ = s.subscribe("SELECT * FROM part WHERE p_size > 5")
    out = s.apply({"part": delta.weighted(p.where("p_size IN (3, 6)"), p.where("p_size IN (4, 5)"))})
    assert quiet not in out
    return out[key]


_TXS = [("p_size = 3", "p_size = 4"), ("p_size = 4", "p_size = 5"), ("p_size = 3", "p_size = 4")]


@query("ivm_by_tx", "SELECT p_partkey, t.tx AS _tx, t.w::BIGINT AS _w FROM part JOIN (VALUES (3, 0, 1), (4, 0, -1), (4, 1, 1), (5, 1, -1), (4, 2, -1)) t(size, tx, w) ON p_size = t.size")
def _(db: Database) -> DataFrame:
    """Three transactions at once: each one's change on its own."""
    p = db.catalog.frames["part"]
    db.catalog.put("part", p.where("p_size <> 3"))
    s = live.Subscriptions(db.catalog)
    key, _ = s.subscribe("SELECT * FROM part")
    changes = live.union([delta.weighted(p.where(came), p.where(gone)).withColumn(delta.TX, F.lit(i)) for i, (came, gone) in enumerate(_TXS)])
    return s.apply({"part": changes})[key].select("p_partkey", delta.TX, delta.WEIGHT)


@query("prune_apply", f"SELECT DISTINCT o_orderpriority AS priority FROM orders WHERE {_ORDERS[0]} OR {_ORDERS[1]}")
def _(db: Database) -> DataFrame:
    """Of the live queries for each priority those that a transaction concerns."""
    deltas = transaction(db)
    s = live.Subscriptions(db.catalog)
    found = {}
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        found[s.subscribe(f"SELECT * FROM orders WHERE o_orderpriority = '{priority}'")[0]] = priority
    return db.catalog.spark.createDataFrame([(found[k],) for k in s.apply({"orders": deltas["orders"]})], "priority string")


@query("stream_restart", "SELECT * FROM part WHERE p_size NOT IN (4, 5) UNION ALL SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size = 5")
def _(db: Database) -> DataFrame:
    """Two batches with a restart between them: the second builds on the first."""
    spark, p = db.catalog.spark, db.catalog.frames["part"]
    first = p.where("p_size <> 5")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    row = F.to_json(F.struct(*p.columns)).alias("row")
    for i, rows in enumerate((delta.weighted(p.where("p_size = 5"), p.limit(0)), delta.weighted(p.limit(0), p.where("p_size = 4")))):
        db.catalog.put("part", first)
        rows.select(F.lit(i).cast("long").alias("_tx"), F.lit("part").alias("_table"), "_w", row).coalesce(1).write.json(f"{folder}/in/{i}")
        live.LiveStream(live.Subscriptions(db.catalog), f"{folder}/out").start(spark, f"{folder}/in/*").awaitTermination()
    return db.catalog.frames["part"]


# -- row-level security


def ruled(db: Database, *rules: str) -> Database:
    _with_identity(db)
    for r in rules:
        security.add_rule(db.catalog, r)
    return db


_MINE = "SELECT * FROM member WHERE identity = :sender"
_RICH = "SELECT * FROM member WHERE c_acctbal > 5000"
_VIA = "SELECT o.* FROM owned o JOIN member m ON o.o_custkey = m.c_custkey WHERE m.identity = :sender"
_COLUMNS = "SELECT c_custkey, c_name FROM member"

query("rls_none", "SELECT c_custkey, c_name FROM customer")(lambda db: ruled(db).sql(_COLUMNS, caller(17)))
query("rls_owner", "SELECT c_custkey, c_name FROM customer")(lambda db: ruled(db, _MINE).sql(_COLUMNS))
query("rls_sender", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 17")(lambda db: ruled(db, _MINE).sql(_COLUMNS, caller(17)))
query("rls_two_rules", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 17 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")(lambda db: ruled(db, _MINE, _RICH).sql(_COLUMNS, caller(17)))
query("rls_count", "SELECT (SELECT count(*) FROM customer WHERE c_custkey = 17) + (SELECT count(*) FROM customer WHERE c_acctbal > 5000) AS n")(lambda db: ruled(db, _MINE, _RICH).sql("SELECT count(*) AS n FROM member", caller(17)))
query("rls_join_rule", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17")(lambda db: ruled(db, _VIA).sql("SELECT o_orderkey, o_totalprice FROM owned", caller(17)))
query("rls_both_sides", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_custkey = 17 AND c.c_custkey = 17 UNION ALL SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_custkey = 17 AND c.c_acctbal > 5000")(
    lambda db: ruled(db, _MINE, _RICH, "SELECT * FROM owned WHERE identity = :sender").sql("SELECT o.o_orderkey, m.c_name FROM owned o JOIN member m ON o.o_custkey = m.c_custkey", caller(17))
)
query("rls_self_ref", "SELECT m.c_custkey, m.c_name FROM customer m JOIN customer o ON m.c_nationkey = o.c_nationkey WHERE o.c_custkey = 17")(
    lambda db: ruled(db, "SELECT m.* FROM member m JOIN customer o ON m.c_nationkey = o.c_nationkey WHERE o.c_custkey = 17").sql(_COLUMNS, caller(17))
)

# -- scalar helpers


@query("sequence_next", "SELECT c_custkey, CASE WHEN c_nationkey + 20 > 30 THEN c_nationkey + 20 - 31 ELSE c_nationkey + 20 END AS up, CASE WHEN c_nationkey - 7 < 0 THEN c_nationkey - 7 + 31 ELSE c_nationkey - 7 END AS down FROM customer")
def _(db: Database) -> DataFrame:
    v = F.col("c_nationkey")
    return db.catalog.frames["customer"].select("c_custkey", V.next_in_sequence(v, 20, 0, 30).alias("up"), V.next_in_sequence(v, -7, 0, 30).alias("down"))


@query("schedule_next_tick", "SELECT event_id, CASE WHEN user_id * 1000 <= epoch_us(ts) - 1000000000 * event_id THEN (user_id * 1000) + 60000000 * (((epoch_us(ts) - 1000000000 * event_id) - user_id * 1000) // 60000000 + CASE WHEN epoch_us(ts) - 1000000000 * event_id = user_id * 1000 THEN 1 ELSE 1 END) ELSE user_id * 1000 + 60000000 END AS tick FROM events")
def _(db: Database) -> DataFrame:
    now = V.micros(F.col("ts")) - F.col("event_id") * 1_000_000_000
    return db.catalog.frames["events"].select("event_id", V.next_tick(F.col("user_id") * 1000, F.lit(-60_000_000).cast("long"), now).alias("tick"))


@query("time_helpers", "SELECT event_id, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS later, 90000000::BIGINT AS micros FROM events")
def _(db: Database) -> DataFrame:
    later = V.add_micros(F.col("ts"), F.lit(90_000_000))
    return db.catalog.frames["events"].select("event_id", F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss").alias("later"), V.micros_between(later, F.col("ts")).alias("micros"))


@query("uuid_helpers", "SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 8) || '-' || substr(md5(doc_id::VARCHAR), 9, 4) || '-' || substr(md5(doc_id::VARCHAR), 13, 4) || '-' || substr(md5(doc_id::VARCHAR), 17, 4) || '-' || substr(md5(doc_id::VARCHAR), 21, 12) AS uuid FROM documents")
def _(db: Database) -> DataFrame:
    b = V.uuid_bytes(V.uuid_text(F.unhex(F.md5(F.col("doc_id").cast("string")))))
    return db.catalog.frames["documents"].select("doc_id", V.uuid_text(b).alias("uuid"))


@query("auto_increment", "SELECT max(c_custkey) + 1 AS first, max(c_custkey) + 2 AS second FROM customer")
def _(db: Database) -> DataFrame:
    c = db.catalog.frames["customer"].select("c_custkey", "c_name")
    db.catalog.add("named", c, {"c_custkey": Type("I64")}, primary_key="c_custkey", sequence="c_custkey")
    fresh = db.change("INSERT INTO named VALUES (0, 'new one'), (0, 'new two')").inserts
    return fresh.agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("second"))


@query("auto_increment_after_delete", "SELECT c_custkey::BIGINT AS c_custkey, c_name FROM customer WHERE c_custkey < 20 UNION ALL SELECT max(c_custkey) + 3, 'third' FROM customer")
def _(db: Database) -> DataFrame:
    """Numbers are not given out again."""
    db.catalog.add("named", db.catalog.frames["customer"].select("c_custkey", "c_name"), {"c_custkey": Type("I64")}, primary_key="c_custkey", sequence="c_custkey")
    db.change("INSERT INTO named VALUES (0, 'first'), (0, 'second')")
    db.change("DELETE FROM named WHERE c_custkey >= 20")
    db.change("INSERT INTO named VALUES (0, 'third')")
    return db.catalog.frames["named"]


@query("pg_format", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(db: Database) -> DataFrame:
    return sinks.wire_rows(db.sql("SELECT * FROM nation"), db.catalog.tables["nation"].columns)


@query("unsigned_columns", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey >= 10 AND c_custkey < 100")
def _(db: Database) -> DataFrame:
    c = db.catalog.frames["customer"].select(F.col("c_custkey").cast("decimal(20,0)").alias("c_custkey"), F.col("c_nationkey").cast("long").alias("c_nationkey"))
    db.catalog.add("u", c, {"c_custkey": U64, "c_nationkey": U32})
    found = db.sql("SELECT * FROM u WHERE c_nationkey >= 1e1 AND c_custkey < 100")
    return found.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("int").alias("c_nationkey"))


# -- workloads

query("wl_cross_join_all", "SELECT (SELECT count(*) FROM customer) * (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part) AS n")(lambda db: workloads.cross_count(*(db.catalog.frames[n] for n in ("customer", "supplier", "part"))))


@query("wl_circle_food_overlap", "SELECT c.c_custkey AS circle, s.s_suppkey AS food FROM customer c CROSS JOIN supplier s WHERE sqrt(pow(c.c_acctbal / 8 - s.s_acctbal / 8, 2) + pow(c.c_nationkey::DOUBLE - s.s_nationkey::DOUBLE, 2)) < greatest(sqrt((c.c_nationkey * 10)::DOUBLE), sqrt((s.s_nationkey * 20)::DOUBLE))")
def _(db: Database) -> DataFrame:
    c = db.catalog.frames["customer"].selectExpr("c_custkey AS id", "c_acctbal / 8 AS x", "CAST(c_nationkey AS DOUBLE) AS y", "c_nationkey * 10 AS mass")
    s = db.catalog.frames["supplier"].selectExpr("s_suppkey AS id", "s_acctbal / 8 AS x", "CAST(s_nationkey AS DOUBLE) AS y", "s_nationkey * 20 AS mass")
    return workloads.overlaps(c, s)


@query("wl_update_all", "SELECT p_partkey, p_name, p_brand, p_type, p_size + 3 AS p_size, p_retailprice FROM part")
def _(db: Database) -> DataFrame:
    p = db.catalog.frames["part"]
    return workloads.advanced(p.withColumn("v", F.lit(3)), [("p_size", "v")]).drop("v")


@query("wl_update_join", "SELECT c.c_custkey, c.c_acctbal + coalesce(s.s_acctbal, 0) AS c_acctbal FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey")
def _(db: Database) -> DataFrame:
    c, s = (db.catalog.frames[n] for n in ("customer", "supplier"))
    return workloads.moved(c.select("c_custkey", "c_acctbal"), s.withColumnRenamed("s_suppkey", "c_custkey"), "c_custkey", [("c_acctbal", "s_acctbal")])


query("wl_index_nested_lookup", "SELECT c.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderpriority = '2-HIGH'")(
    lambda db: workloads.nested_lookup(db.catalog.frames["orders"], "o_orderpriority", "2-HIGH", db.catalog.frames["customer"], "c_custkey", "o_custkey")
)

_TRANSFERS = "SELECT l_suppkey AS f, l_partkey AS t, l_linenumber::BIGINT AS amount FROM lineitem WHERE l_suppkey <> l_partkey"


@query(
    "wl_transfer",
    f"WITH a AS (SELECT p_partkey AS id, (p_size * 60)::BIGINT AS balance FROM part), o AS ({_TRANSFERS}), s AS (SELECT f, sum(amount) AS spent FROM o GROUP BY f), p AS (SELECT o.* FROM o JOIN s ON o.f = s.f JOIN a ON a.id = o.f AND a.balance >= s.spent WHERE o.t IN (SELECT id FROM a)), n AS (SELECT k, sum(d) AS d FROM (SELECT f AS k, -amount AS d FROM p UNION ALL SELECT t, amount FROM p) GROUP BY k) SELECT a.id, (a.balance + coalesce(n.d, 0))::BIGINT AS balance FROM a LEFT JOIN n ON a.id = n.k",
)
def _(db: Database) -> DataFrame:
    accounts = db.catalog.frames["part"].selectExpr("p_partkey AS id", "CAST(p_size * 60 AS BIGINT) AS balance")
    orders = db.catalog.frames["lineitem"].selectExpr("l_suppkey AS `from`", "l_partkey AS `to`", "CAST(l_linenumber AS BIGINT) AS amount")
    return workloads.transfer(accounts, orders)


# -- sample tables without a relational counterpart: scans, filters, counts

statement("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
statement("count_documents", "SELECT count(*) AS n FROM documents WHERE lang = 'en'")


def _other(name: str, table: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Database(sample_catalog(spark, sf_dir, table)).sql(sql)

    _QUERIES[name], _SQL[name] = run, sql


_other("scan_embeddings", "embeddings", "SELECT vec_id, label FROM embeddings WHERE label >= 3")
_other("scan_pages", "pages", "SELECT page_id, url FROM pages")
_other("count_conversations", "conversations", "SELECT count(*) AS n FROM conversations WHERE role = 'user'")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
