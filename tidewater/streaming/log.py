"""The commit log: every transaction's changes of a table, in order; any past state can be read back.

A log is a table of rows with _tx (the transaction) and _w (+1 inserted, -1 deleted). A truncation is one entry in
a table of its own: (_tx)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.delta import WEIGHT
from tidewater.operators.lower import ref

TX = "_tx"


def entries(tx: int, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """What a transaction adds to the log."""
    w = lambda df, n: df.withColumn(TX, F.lit(tx).cast("long")).withColumn(WEIGHT, F.lit(n).cast("long"))
    return w(inserts, 1).unionByName(w(deletes, -1))


def append(path: str, tx: int, inserts: DataFrame, deletes: DataFrame) -> None:
    """Writes a transaction under its own folder; writing it again replaces it, so a retry is harmless."""
    entries(tx, inserts, deletes).drop(TX).write.mode("overwrite").parquet(f"{path}/{TX}={tx}")


def replay(log: DataFrame, as_of: int | None = None, truncated_at: int | None = None) -> DataFrame:
    """The table after transaction as_of (None: the last). A row is there if its last change was an insert."""
    rows = log if as_of is None else log.where(F.col(TX) <= as_of)
    rows = rows if truncated_at is None else rows.where(F.col(TX) > truncated_at)
    columns = [ref(c) for c in log.columns if c not in (TX, WEIGHT)]
    # within a transaction deletes come before inserts
    last = F.max(F.struct(TX, WEIGHT)).alias("last")
    return rows.groupBy(*columns).agg(last).where(f"last.{WEIGHT} > 0").select(*columns)
