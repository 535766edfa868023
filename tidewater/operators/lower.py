"""Logical plans as DataFrames. Filters sit on the relations they name and columns are pruned by Catalyst, so both
reach the Parquet scan; join algorithms and order are Catalyst's and AQE's."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.catalog import Catalog, sender_hash
from tidewater.plans.logical import Both, Compare, Field, Fragment, Query, Sender, SenderHash, Value
from tidewater.plans.types import TIMESTAMP, Type, stored


def name_of(alias: str, column: str) -> str:
    """Name of a column while its relation is being joined."""
    return f"{alias}.{column}"


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def constant(value: Any, t: Type, kind: str | None = None) -> Column:
    """A literal of the column's storage type."""
    if t == TIMESTAMP and kind == "timestamp_ntz":
        return F.lit(value.replace(tzinfo=None)).cast("timestamp_ntz")
    return F.lit(value).cast(kind or stored(t))


class Lowering:
    def __init__(self, catalog: Catalog, caller: bytes | None = None, frames: dict[str, DataFrame] | None = None, states: dict[str, DataFrame] | None = None) -> None:
        self.catalog = catalog
        self.caller = caller if caller is not None else catalog.owner
        self.frames = frames or {}  # by alias: instead of the table's current rows
        self.states = states or catalog.frames  # by table

    def relation(self, alias: str, table: str) -> DataFrame:
        frame = self.frames.get(alias)
        frame = self.states[table] if frame is None else frame
        return frame.select(*[ref(c).alias(name_of(alias, c)) for c in frame.columns])

    def expression(self, e: Any, kinds: dict[str, str]) -> Column:
        if isinstance(e, Field):
            return ref(name_of(e.alias, e.column))
        if isinstance(e, Value):
            return constant(e.value, e.type)
        if isinstance(e, Sender):
            return F.lit(self.caller)
        if isinstance(e, SenderHash):
            return F.lit(sender_hash(self.caller))
        if isinstance(e, Both):
            spine = [e]
            while isinstance(spine[-1].left, Both):
                spine.append(spine[-1].left)
            out = self.expression(spine[-1].left, kinds)
            for link in reversed(spine):
                right = self.expression(link.right, kinds)
                out = (out & right) if link.op == "and" else (out | right)
            return out
        left, right = self._sides(e, kinds)
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[e.op]

    def _sides(self, e: Compare, kinds: dict[str, str]) -> tuple[Column, Column]:
        """Constants take the storage type of the column on the other side, so that the scan can use them."""
        out = []
        for side, other in ((e.left, e.right), (e.right, e.left)):
            if isinstance(side, Value) and isinstance(other, Field):
                out.append(constant(side.value, side.type, kinds.get(name_of(other.alias, other.column))))
            else:
                out.append(self.expression(side, kinds))
        return out[0], out[1]

    def body(self, f: Fragment) -> DataFrame:
        """The joined and filtered rows; columns are named alias.column."""
        left = list(f.relations)
        joins = list(f.joins)
        alias, table = left.pop(0)
        out, known = self.relation(alias, table), {alias}
        while left:
            # a relation that is joined with what is there comes before one that would be crossed with it
            place = next((i for i, (a, _) in enumerate(left) if any({x.alias, y.alias} - {a} <= known and a in (x.alias, y.alias) for x, y in joins)), 0)
            alias, table = left.pop(place)
            known.add(alias)
            now = [j for j in joins if {j[0].alias, j[1].alias} <= known]
            joins = [j for j in joins if j not in now]
            right = self.relation(alias, table)
            if now:
                out = out.join(right, reduce(lambda a, b: a & b, [ref(name_of(x.alias, x.column)) == ref(name_of(y.alias, y.column)) for x, y in now]))
            else:
                out = out.crossJoin(right)
        kinds = dict(out.dtypes)
        for x, y in joins:  # a join of a relation with itself by alias
            out = out.where(ref(name_of(x.alias, x.column)) == ref(name_of(y.alias, y.column)))
        for w in f.where:
            out = out.where(self.expression(w, kinds))
        return out

    def query(self, q: Query) -> DataFrame:
        parts = []
        for f in q.fragments:
            body = self.body(f)
            if q.count is not None:
                parts.append(body.select(F.lit(1).alias("one")))
            elif q.table is not None:
                parts.append(body.select(*[ref(name_of(f.out, c)).alias(c) for c in self.catalog.tables[q.table].visible]))
            else:
                parts.append(body.select(*[ref(name_of(c.alias, c.column)).alias(n) for c, n in q.columns]))
        out = reduce(DataFrame.unionByName, parts)
        if q.count is not None:
            out = out.agg(F.count(F.lit(1)).alias(q.count))
        return out if q.limit is None else out.limit(min(q.limit, (1 << 31) - 1))
