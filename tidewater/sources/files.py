"""Folders of any file system that Spark reaches: listing, removing, and tables written to the shared one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(hadoop), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in path whose writing was finished; none if there is no such path."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return []
    found = [s.getPath() for s in fs.listStatus(place) if s.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [p.getName() for p in found if fs.exists(done(p, "_SUCCESS"))]


def numbered(spark: SparkSession, path: str) -> list[int]:
    """The finished folders with a number (as 7 or batch=7), sorted."""
    return sorted(int(n) for name in children(spark, path) if (n := name.rpartition("=")[2]).isdigit())


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under path."""
    fs, place = _at(spark, path)
    return fs.getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in a local session without it a new one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidewater-')}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
