"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import ann, bpe, langid, media, mixing, near, repeats, sharding, url_filter, warc
from tidewater.llm.common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read(media.store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), bpe.public_vocabulary()))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    model = langid.fit(docs.where(~held_out))
    found = langid.predict(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")), strict=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


#: Shards of the registered query.
SHARDS = [f"shard-{i:03d}" for i in range(100)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_ann, op2_media_columns, op3_repeated_bytes, op4_bpe, op5_mix_sources, op6_near_duplicates, op7_language_id, op8_shard_lookup, op9_warc, op10_url_filter)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {"op5_mix_sources": mixing.ORACLE, "op9_warc": warc.ORACLE, "op10_url_filter": url_filter.ORACLE}
