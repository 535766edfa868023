"""The engine: statements in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.errors import AccessProblem
from tidewater.operators import changes, delta
from tidewater.operators.lower import Lowering
from tidewater.plans import cost, security
from tidewater.plans.catalog import Catalog
from tidewater.plans.logical import DeletePlan, InsertPlan, Query, UpdatePlan, Variable, bind
from tidewater.plans.syntax import parse


@dataclass
class Changed:
    """Result of an INSERT, DELETE or UPDATE: the rows that came and went, and how to count what happened."""

    table: str
    inserts: DataFrame
    deletes: DataFrame
    matched: DataFrame | None = None  # of an UPDATE: also those that stay as they are

    def metrics(self) -> dict[str, int]:
        """Costs a job or two."""
        if self.matched is not None:
            return {"updated": self.matched.count()}
        return {"inserted": self.inserts.count(), "deleted": self.deletes.count()}


class Database:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.row_limit: int | None = None

    def plan(self, sql: str, caller: bytes | None = None) -> Query:
        found = bind(self.catalog, sql, caller)
        assert isinstance(found, Query)
        return security.secured(self.catalog, found, caller)

    def sql(self, sql: str, caller: bytes | None = None) -> DataFrame:
        """Runs any statement for a caller (None: the owner). What does not return rows returns an empty frame."""
        found = bind(self.catalog, sql, caller)
        spark = self.catalog.spark
        if isinstance(found, Query):
            found = security.secured(self.catalog, found, caller)
            cost.admit(self.catalog, found, self.row_limit, exempt=caller is None or caller == self.catalog.owner)
            return Lowering(self.catalog, caller).query(found)
        if isinstance(found, Variable):
            if found.value is None:
                return spark.createDataFrame([(self.row_limit,)] if self.row_limit is not None else [], "row_limit bigint")
            if caller not in (None, self.catalog.owner):
                raise AccessProblem("only the owner may set variables")
            self.row_limit = found.value
        else:
            self.change(sql, caller)
        return spark.createDataFrame([], "ok boolean")

    def change(self, sql: str, caller: bytes | None = None) -> Changed:
        """Runs an INSERT, DELETE or UPDATE and moves the table to its new state."""
        plan = bind(self.catalog, sql, caller)
        if caller not in (None, self.catalog.owner):
            raise AccessProblem("only the owner may change tables by SQL")
        name = plan.table  # type: ignore[union-attr]
        table, old = self.catalog.tables[name], self.catalog.frames[name]
        if table.sequence:
            self.catalog.start_sequence(name)  # from the rows before the first change
        if isinstance(plan, InsertPlan):
            fresh = changes.literal_rows(self.catalog, plan, caller)
            new, out = old.unionByName(fresh), Changed(name, fresh, old.limit(0))
        elif isinstance(plan, DeletePlan):
            new = changes.delete(self.catalog, plan, caller)
            out = Changed(name, old.limit(0), changes.matched(self.catalog, name, plan.where, caller))
        else:
            assert isinstance(plan, UpdatePlan)
            came, gone = changes.updated(self.catalog, plan, caller)
            assigned = {c for c, _ in plan.values}
            if any(i.unique and set(i.columns) & assigned for i in table.indexes):
                rest = old.join(gone, changes.same(old, gone, old.columns), "left_anti")
                changes.check_unique(table, rest, came, assigned)
            new = changes.update(self.catalog, plan, caller)
            out = Changed(name, came, gone, changes.matched(self.catalog, name, plan.where, caller))
        self.catalog.move(name, new, delta.weighted(out.inserts, out.deletes))
        return out

    def visible_tables(self, caller: bytes | None = None) -> list[str]:
        """What SELECT * FROM * stands for: all public user tables that are not event tables."""
        return self.catalog.visible_tables()

    def everything(self, caller: bytes | None = None) -> dict[str, DataFrame]:
        return {name: self.sql(f'SELECT * FROM "{name}"', caller) for name in self.visible_tables(caller)}

    def cached(self, queries: list[str], caller: bytes | None = None) -> DataFrame:
        """What a client shows that subscribed to several queries over one table: equal rows once."""
        return reduce(DataFrame.unionByName, [self.sql(q, caller) for q in queries]).distinct()

    def row_counts(self) -> DataFrame:
        counts = [self.catalog.frames[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in self.catalog.tables]
        return reduce(DataFrame.unionByName, counts)


def is_select(sql: str) -> bool:
    return type(parse(sql)).__name__ == "Select"
