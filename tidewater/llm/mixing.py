"""Mixing sources to target weights by weighted fair queueing (native DataFrame operations only).

Every document is queued once per epoch in an order shuffled by hash. Its virtual finish time is
the running number of words of its source, itself included, divided by the source's target; the mix
is the global order of finish times, cut where the total budget is spent. The document at the cut
gives the words that are left of the budget.

Running sums are made in two levels: per bucket of the order, then within a bucket. So no task
holds a whole source; the number of buckets grows with the number of rows, up to MOST_BUCKETS.

Defined results: null text counts no words and takes none; a null source is a source of its own,
last in order; repeated rows are separate documents (identical ones that stand at the cut are cut
alike); a table without words gives targets and takings of 0; an empty table gives an empty result.
Only the columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows aimed at per bucket of a running sum.
BUCKET_ROWS = 512
#: Buckets at most: so many sums of a source (and of ranges of finish times) go through one window.
MOST_BUCKETS = 1 << 16
EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """source, source_size -> also target: shares of share * all sizes by weight, none above EPOCHS
    times its source's size; what is above is dealt to the others by weight (water filling).
    One row a source, so its windows hold few rows."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    level = (F.col("all") - F.col("caps_before")) / F.col("weights_left")
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * EPOCHS)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        # in order of ratio, the first source that stays below its cap fixes the level; later ones are lower
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def _finish(epoch: int) -> Column:
    """Virtual finish time of a document's pass in an epoch."""
    return F.coalesce(F.try_divide((F.col("upto") + epoch * F.col("source_size")).cast("double"), F.col("target")), F.lit(0.0))


def _place(epoch: int) -> Column:
    """Place of a pass in the mix; comparable."""
    return F.struct(_finish(epoch).alias("finish"), F.col("shuffled"), F.col("size"), F.lit(epoch).alias("epoch"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """keep, size, source_size, target and takes (array<long>: the words taken in each epoch) of every row."""
    sized = docs.select(*keep, F.col("source").alias("_source"), words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(id).cast("string"), F.lit(""))).alias("shuffled"))
    sized_ = written(sized, "mix-sizes")  # a few bytes a row; the texts are read once
    buckets = min(MOST_BUCKETS, max(1, sized_.count() // BUCKET_ROWS))
    u = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    sized = sized_.withColumn("bucket", F.shiftright(u * buckets, 32))
    parts = sized.groupBy("_source", "bucket").agg(F.sum("size").alias("part"))
    goal = written(targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("part").alias("source_size")), weights, share), "mix-targets")
    before = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("part").over(before), F.lit(0)).alias("before"))
    parts = parts.join(goal, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("_source", "bucket").orderBy("shuffled", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        sized.withColumn("inside", F.sum("size").over(within))
        .join(parts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .withColumn("upto", F.col("before") + F.col("inside"))
        .drop("_s", "_b", "before", "inside", "bucket")
    )
    queued = written(queued, "mix-queued")  # what follows reads it three times
    discard(sized_)
    budget = goal.agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0))).alias("budget")).scalar()
    passes = queued.select("size", F.explode(F.array(*[_place(e) for e in range(EPOCHS)])).alias("place"))
    passes = passes.withColumn("range", F.floor(F.col("place.finish") * (4 * buckets)))
    ranges = passes.groupBy("range").agg(F.sum("size").alias("part"))
    # the one range in which the budget is spent
    total = F.sum("part").over(Window.orderBy("range"))
    spent = ranges.withColumn("total", total).withColumn("budget", budget).where("total >= budget and total - part < budget").select(F.col("range").alias("_r"), (F.col("budget") - F.col("total") + F.col("part")).alias("left"))
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        passes.join(F.broadcast(spent), F.col("range") == F.col("_r"))
        .withColumn("total", F.sum("size").over(order))
        .where("total >= left and total - size < left")
        .select(F.col("place").alias("cut"), (F.col("left") - F.col("total") + F.col("size")).alias("rest"))
    )
    cut = cut.agg(F.struct(F.max("cut").alias("cut"), F.max("rest").alias("rest"))).scalar()  # nulls if nothing is taken
    take = lambda e: F.when(_place(e) < F.col("at.cut"), F.col("size")).when(_place(e) == F.col("at.cut"), F.col("at.rest")).otherwise(F.lit(0)).cast("long")
    return queued.withColumn("at", cut).select(*keep, "size", "source_size", "target", F.array(*[take(e) for e in range(EPOCHS)]).alias("takes"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS shuffled FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), c AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS everything FROM w
), l AS (
  SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), m AS (SELECT max(level) AS level FROM l WHERE ratio > level
), t AS (
  SELECT c.source, c.source_size, CASE WHEN m.level IS NULL OR c.ratio <= m.level THEN c.cap::DOUBLE ELSE c.weight * m.level END AS target FROM c CROSS JOIN m
), q AS (
  SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT doc_id, size, source_size, target, shuffled, e.epoch, CASE WHEN target > 0 THEN (upto + e.epoch * source_size)::DOUBLE / target ELSE 0.0::DOUBLE END AS finish
  FROM q CROSS JOIN (SELECT 0 AS epoch UNION ALL SELECT 1 AS epoch) e
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, shuffled, size, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM p
), b AS (SELECT floor(sum(target))::BIGINT AS budget FROM t)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, b.budget - (total - size))))::BIGINT AS taken
FROM r CROSS JOIN b GROUP BY doc_id, size, source_size, target
"""
