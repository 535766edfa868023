"""What the operators share: the folder all executors reach, and reading of tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.files import remove, shared_dir, size


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: lineage ends here,
    and an executor that is lost later loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` gave. What was made of them must have been written itself."""
    for t in tables:
        if t is not None:
            remove(t.sparkSession, t._written)


#: Bytes on disk of a table of keys that is broadcast; beyond it a join shuffles.
FEW = 8 << 20


def few(keys: DataFrame, most: int = FEW) -> DataFrame:
    """keys (a written table of short rows), broadcast if its files are small. Told so before it is planned, a join does
    not shuffle its other side, where one key may have a third of the rows."""
    return F.broadcast(keys) if size(keys.sparkSession, keys._written) <= most else keys


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, not when the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows go to Python in Arrow batches of at most about size bytes, so that long texts don't add up there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives memory back to the system when its task ends. Python workers are
    used again by later tasks, and what an allocator keeps would count against the executor until then."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
