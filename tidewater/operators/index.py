"""Reads by index: points, prefixes and ranges. Spark has no such indexes; the conditions reach the scan as
pushed filters, where Parquet statistics skip row groups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.errors import BindProblem
from tidewater.plans.catalog import Catalog


@dataclass(frozen=True)
class Bound:
    """kind: included, excluded or unbounded."""

    kind: str
    value: Any = None


def included(value: Any) -> Bound:
    return Bound("included", value)


def excluded(value: Any) -> Bound:
    return Bound("excluded", value)


UNBOUNDED = Bound("unbounded")


@dataclass(frozen=True)
class Range:
    start: Bound = UNBOUNDED
    stop: Bound = UNBOUNDED

    def holds(self, c: Column) -> Column | None:
        parts = []
        if self.start.kind != "unbounded":
            parts.append(c >= self.start.value if self.start.kind == "included" else c > self.start.value)
        if self.stop.kind != "unbounded":
            parts.append(c <= self.stop.value if self.stop.kind == "included" else c < self.stop.value)
        return reduce(lambda a, b: a & b, parts) if parts else None


def scan(frame: DataFrame, columns: tuple[str, ...], *keys: Any) -> DataFrame:
    """Rows whose columns, from the left, equal keys; the last key may be a Range."""
    if not keys or len(keys) > len(columns) or any(isinstance(k, Range) for k in keys[:-1]):
        raise BindProblem("an index takes values for its columns from the left, and a range for the last one given")
    for c, k in zip(columns, keys, strict=False):
        condition = k.holds(F.col(c)) if isinstance(k, Range) else F.col(c) == k
        frame = frame if condition is None else frame.where(condition)
    return frame


def by_index(catalog: Catalog, table: str, columns: tuple[str, ...], *keys: Any) -> DataFrame:
    found = next((i for i in catalog.tables[table].indexes if i.columns == columns), None)
    if not found:
        raise BindProblem(f"`{table}` has no index on {columns}")
    if found.kind == "hash" and (len(keys) < len(columns) or isinstance(keys[-1], Range)):
        raise BindProblem("a hash index only finds whole keys")
    return scan(catalog.frames[table], columns, *keys)


def by_column(frame: DataFrame, column: str, key: Any) -> DataFrame:
    """With or without an index."""
    return scan(frame, (column,), key)


def find(catalog: Catalog, table: str, column: str, key: Any) -> DataFrame:
    """At most one row, by a unique column."""
    if not catalog.tables[table].is_unique({column}):
        raise BindProblem(f"`{column}` of `{table}` is not unique")
    return scan(catalog.frames[table], (column,), key).limit(1)


def distinct_keys(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: the number of distinct keys, exactly."""
    return frame.select(*columns).distinct().agg(F.count(F.lit(1)).alias("keys"))


def read_your_writes(base: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """What a transaction sees: committed rows without its deletes, with its inserts (tables are sets)."""
    from tidewater.operators.changes import same

    return base.join(deletes, same(base, deletes, base.columns), "left_anti").unionByName(inserts)
