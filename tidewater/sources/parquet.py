"""Parquet tables with known schemas, registered in a catalogue."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewater.plans.catalog import Catalog, Index

#: Unique keys, and columns that other tables refer to, of the sample tables.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}
INDEXES = {
    "nation": [("n_regionkey",)], "customer": [("c_nationkey",), ("c_mktsegment",)], "supplier": [("s_nationkey",)], "orders": [("o_custkey",), ("o_orderstatus", "o_orderpriority"), ("o_custkey", "o_totalprice")],
    "lineitem": [("l_orderkey",), ("l_partkey",), ("l_suppkey",), ("l_returnflag", "l_linestatus", "l_linenumber")], "events": [("user_id",), ("event_type",)],
}


def sample_catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """The named sample tables (all nine relational ones if none is)."""
    catalog = Catalog(spark)
    for name in names or ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        indexes = [Index(c) for c in INDEXES.get(name, [])]
        catalog.add(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), primary_key=KEYS.get(name), indexes=indexes, event=name == "events")
    return catalog
