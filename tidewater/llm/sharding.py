"""Consistent placement by a permutation-filled lookup table (native DataFrame operations only).

The shards take turns claiming slots of a prime-sized table, each walking its own permutation
(offset + j * skip) mod size. The filled table has a fixed number of rows, so it is broadcast,
and one equi-join on hash(key) mod size places a row.

Defined results: a null key is placed like the empty string; equal keys go to one shard; an empty
table gives an empty result; extra columns are not read; no shards is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime well above a hundred slots a shard, for up to about 650 shards.
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the place in ``shards`` of its owner."""
    if not shards or len(shards) > size:
        raise ValueError("between one shard and as many as the table has slots are needed")
    walk = [(_number(f"offset:{s}") % size, _number(f"skip:{s}") % (size - 1) + 1) for s in shards]
    owner, step, taken = [-1] * size, [0] * len(shards), 0
    while True:
        for i, (offset, skip) in enumerate(walk):
            while owner[slot := (offset + step[i] * skip) % size] >= 0:
                step[i] += 1
            owner[slot], step[i], taken = i, step[i] + 1, taken + 1
            if taken == size:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, shards: list[str], key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), size: int = TABLE_SIZE) -> DataFrame:
    """keep, slot int and shard string of every row."""
    owner = fill(shards, size)
    slots = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owner)], "slot int, shard string")
    return df.select(*keep, slot_of(F.col(key), size).alias("slot")).join(F.broadcast(slots), "slot").select(*keep, "slot", "shard")
