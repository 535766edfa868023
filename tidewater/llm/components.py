"""Connected components of an edge table (native DataFrame operations), by alternating large and small
stars. Every step is one aggregation and one join; edges end as stars around the least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (comparable, not null). a, b of every node that is not the least of its component, b being
    the least. Written to the shared folder after every round. The centre of a star is one key of joins whose other side has
    one row a key, which AQE splits; minima are formed before the shuffle."""
    now = written(edges.where("a <> b").select("a", "b").distinct(), "components")
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            return now
        seen = state
        before, now = now, written(_small(_large(now)), "components")
        discard(before)
