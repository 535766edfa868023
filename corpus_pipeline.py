"""A training corpus from the documents table: language ID, near-duplicate removal, repeat removal, mixing of
sources, encoding. Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame,
which is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, langid, mixing, near, repeats
from tidewater.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows whose keys are broadcast; beyond it those joins shuffle.
FEW = 500_000


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= FEW else keys


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letters (``und``) go; a missing lang becomes the predicted one."""
    found = langid.predict(docs, langid.fit(docs), keep=COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id stays (of equal rows one)."""
    rows = written(near.classes(docs).select("ord", "tie", "first"), "pipeline-classes")
    losers = rows.where(F.struct("ord", "tie") > F.col("first")).select("ord", "tie").distinct()
    repeated = rows.where(F.struct("ord", "tie") == F.col("first")).groupBy("ord", "tie").count().where("count > 1").select("ord", "tie")
    base = docs.select(*COLUMNS, *near.keys())
    kept = base.join(_small(losers), ["ord", "tie"], "left_anti")
    if not repeated.isEmpty():
        again = _small(repeated)
        kept = kept.join(again, ["ord", "tie"], "left_anti").unionByName(kept.join(again, ["ord", "tie"], "left_semi").dropDuplicates(["ord", "tie"]))
    return kept.select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bytes of passages that occur earlier go."""
    found = repeats.remove(docs, keep=("doc_id", "lang", "source"), with_kept=True)
    return found.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass in which a document is taken; the one at the cut keeps its first words."""
    keyed = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    mixed = mixing.mix(keyed, keep=("doc_id", "source", "key")).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_key"), "size", "takes")
    mixed = written(mixed, "pipeline-takes")
    if not mixed.groupBy("_id", "_source", "_key").count().where("count > 1").isEmpty():  # equal rows: their passes are counted together
        keyed = keyed.dropDuplicates(["doc_id", "source", "key"])
    each = mixed.select("_id", "_source", "_key", "size", F.explode("takes").alias("take")).where("take > 0")
    taken = each.groupBy("_id", "_source", "_key", "size", "take").agg(F.count(F.lit(1)).alias("passes"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key"))
    passes = keyed.join(taken, on).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), "passes")))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), F.lit(1), F.col("take").cast("int")), " ")
    return passes.withColumn("text", F.when(F.col("take") < F.col("size"), first).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, as digests and their number."""
    return bpe.digests(bpe.encode(docs, bpe.public_vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", drop_near_duplicates),
    ("repeat_removal", remove_repeats),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: SQL can express neither the trained language model nor the merges; the tests have a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
