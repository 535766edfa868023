"""A typed query builder. It makes the same SQL text that could be written by hand; the DataFrame comes from that
text, so the two cannot differ."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame

from tidewater.errors import BindProblem
from tidewater.plans.catalog import Catalog, Table
from tidewater.plans.types import BYTES, CONNECTION, IDENTITY, Type


def quoted(name: str) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in name.split("."))


def literal_sql(value: Any, t: Type | None = None) -> str:
    """A value as SQL text."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (bytes, bytearray)) or t in (BYTES, IDENTITY, CONNECTION):
        return "0x" + bytes(value).hex()
    if isinstance(value, datetime):
        at = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value
        part = f".{at.microsecond:06d}" if at.microsecond % 1000 else f".{at.microsecond // 1000:03d}" if at.microsecond else ""
        zone = at.strftime("%z") or "+0000"
        return f"'{at:%Y-%m-%dT%H:%M:%S}{part}{zone[:3]}:{zone[3:5]}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


class Condition:
    """A condition; test() evaluates it on one row, as a client does with its cache."""

    def __init__(self, sql: str, test) -> None:
        self.sql, self.test = sql, test

    def and_(self, *others: Condition) -> Condition:
        return _joined("AND", (self, *others))

    def or_(self, *others: Condition) -> Condition:
        return _joined("OR", (self, *others))

    __and__, __or__ = and_, or_

    def not_(self) -> Condition:
        """For test() only: the SQL has no NOT, so a query with it is refused when it is bound."""
        return Condition(f"(NOT {self.sql})", lambda row: not self.test(row))


def _joined(word: str, parts: tuple[Condition, ...]) -> Condition:
    every = all if word == "AND" else any
    sql = parts[0].sql
    for p in parts[1:]:
        sql = f"({sql} {word} {p.sql})"
    return Condition(sql, lambda row: every(p.test(row) for p in parts))


def and_(*parts: Condition) -> Condition:
    return _joined("AND", parts)


def or_(*parts: Condition) -> Condition:
    return _joined("OR", parts)


class Column(Condition):
    """A column; a boolean one is a condition itself."""

    def __init__(self, table: Table, name: str) -> None:
        self.table, self.name, self.type = table, name, table.type_of(name)
        super().__init__(f"{quoted(table.name)}.{quoted(name)}", lambda row: row[name])

    def _compare(self, op: str, other: Any, check) -> Condition:
        if isinstance(other, Column):
            if other.type != self.type:
                raise BindProblem(f"{self.type} is compared with {other.type}")
            return Condition(f"({self.sql} {op} {other.sql})", lambda row: check(row[self.name], row[other.name]))
        return Condition(f"({self.sql} {op} {literal_sql(other, self.type)})", lambda row: check(row[self.name], other))

    def eq(self, other: Any) -> Condition:
        return self._compare("=", other, lambda a, b: a == b)

    def ne(self, other: Any) -> Condition:
        return self._compare("<>", other, lambda a, b: a != b)

    def lt(self, other: Any) -> Condition:
        return self._compare("<", other, lambda a, b: a < b)

    def lte(self, other: Any) -> Condition:
        return self._compare("<=", other, lambda a, b: a <= b)

    def gt(self, other: Any) -> Condition:
        return self._compare(">", other, lambda a, b: a > b)

    def gte(self, other: Any) -> Condition:
        return self._compare(">=", other, lambda a, b: a >= b)

    def indexed(self) -> bool:
        return any(i.columns[0] == self.name for i in self.table.indexes)


class Columns:
    def __init__(self, table: Table) -> None:
        self._table = table

    def __getattr__(self, name: str) -> Column:
        return Column(self._table, name)

    __getitem__ = __getattr__


class Rows:
    """Rows of one table that a condition holds for."""

    def __init__(self, catalog: Catalog, table: Table, condition: Condition | None = None) -> None:
        self.catalog, self.table, self.condition = catalog, table, condition
        self.columns = Columns(table)

    def where(self, choose) -> Rows:
        """choose: a Condition, or a function from the columns to one. Further ones are joined by AND."""
        c = choose(self.columns) if callable(choose) and not isinstance(choose, Condition) else choose
        if not isinstance(c, Condition):
            c = Condition(literal_sql(bool(c)), lambda row: bool(c))
        return Rows(self.catalog, self.table, c if self.condition is None else self.condition.and_(c))

    filter = where

    def _join(self, other: Rows | From, on, out: Table, conditions: list[Condition | None], first: str | None = None) -> Joined:
        if other.table.name == self.table.name:
            raise BindProblem("a table cannot be semijoined with itself")
        a, b = on(self.columns, Columns(other.table))
        if a.type != b.type:
            raise BindProblem(f"{a.type} is joined with {b.type}")
        if not (a.indexed() and b.indexed()):
            raise BindProblem("both columns of a semijoin need an index")
        tables = [self.table.name, other.table.name] if first in (None, self.table.name) else [other.table.name, self.table.name]
        text = f"SELECT {quoted(out.name)}.* FROM {quoted(tables[0])} JOIN {quoted(tables[1])} ON {a.sql} = {b.sql}"
        return Joined(self.catalog, text, Columns(out), [c for c in conditions if c is not None])

    def left_semijoin(self, other: Rows, on, filter_first: bool = False) -> Joined:
        """Rows of this table, one for each match (not each once). filter_first: the text names the other table, and its
        conditions, first, as some clients' builders do."""
        if filter_first:
            return self._join(other, on, self.table, [other.condition, self.condition], other.table.name)
        return self._join(other, on, self.table, [self.condition, other.condition])

    def right_semijoin(self, other: Rows, on) -> Joined:
        """Rows of the other table, one for each match."""
        return self._join(other, on, other.table, [self.condition, other.condition])

    @property
    def sql(self) -> str:
        return f"SELECT * FROM {quoted(self.table.name)}" + (f" WHERE {self.condition.sql}" if self.condition else "")

    build = sql

    def frame(self, caller: bytes | None = None) -> DataFrame:
        return _frame(self.catalog, self.sql, caller)

    def matches(self, row: dict[str, Any]) -> bool:
        """On the client: does this row belong to the result?"""
        return self.condition is None or bool(self.condition.test(row))


From = Rows


class Joined:
    def __init__(self, catalog: Catalog, text: str, columns: Columns, conditions: list[Condition]) -> None:
        self.catalog, self.text, self.columns, self.conditions = catalog, text, columns, conditions

    def where(self, choose) -> Joined:
        return Joined(self.catalog, self.text, self.columns, [*self.conditions, choose(self.columns)])

    filter = where

    @property
    def sql(self) -> str:
        return self.text + (f" WHERE {and_(*self.conditions).sql}" if self.conditions else "")

    build = sql

    def frame(self, caller: bytes | None = None) -> DataFrame:
        return _frame(self.catalog, self.sql, caller)


def table(catalog: Catalog, name: str) -> Rows:
    return Rows(catalog, catalog.table(name))


def _frame(catalog: Catalog, sql: str, caller: bytes | None) -> DataFrame:
    from tidewater.engine import Database

    return Database(catalog).sql(sql, caller)
