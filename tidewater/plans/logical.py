"""The logical plan and how statements are bound to it.

Inner joins and filters commute, so a query body is kept flat: a Fragment has relations (each under a
unique alias), join equalities, and conditions. A query is one or more fragments (several once row-level
security has been applied) whose rows are added up, and what is made of them. Catalyst orders the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from tidewater.errors import BindProblem
from tidewater.plans import syntax as S
from tidewater.plans.catalog import ARG_HASH, Catalog, Table
from tidewater.plans.types import BOOL, BYTES, IDENTITY, STRING, Type, comparable, literal

MOST_TYPING_DEPTH = 2_500


@dataclass(frozen=True)
class Value:
    value: Any
    type: Type


@dataclass(frozen=True)
class Field:
    alias: str
    column: str
    type: Type


@dataclass(frozen=True)
class Sender:
    type: Type


@dataclass(frozen=True)
class SenderHash:
    """The caller as the argument of a view kept per caller."""

    type: Type = BYTES


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any
    type: Type = BOOL


@dataclass(frozen=True)
class Both:
    op: str  # and, or
    left: Any
    right: Any
    type: Type = BOOL


@dataclass(frozen=True)
class Fragment:
    relations: tuple[tuple[str, str], ...]  # (alias, table)
    joins: tuple[tuple[Field, Field], ...] = ()
    where: tuple[Any, ...] = ()
    out: str = ""  # alias whose rows are returned, for queries of whole rows

    def table_of(self, alias: str) -> str:
        return dict(self.relations)[alias]


@dataclass(frozen=True)
class Query:
    fragments: tuple[Fragment, ...]
    table: str | None = None  # rows of this table, or
    columns: tuple[tuple[Field, str], ...] = ()  # these columns, or
    count: str | None = None  # a count under this name
    limit: int | None = None


@dataclass(frozen=True)
class InsertPlan:
    table: str
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class DeletePlan:
    table: str
    where: Any = None


@dataclass(frozen=True)
class UpdatePlan:
    table: str
    values: tuple[tuple[str, Any], ...]
    where: Any = None


@dataclass(frozen=True)
class Variable:
    name: str
    value: int | None = None  # None: show it


@dataclass
class Scope:
    """Aliases of a FROM clause."""

    tables: dict[str, Table] = field(default_factory=dict)

    def add(self, alias: str, table: Table) -> None:
        if alias in self.tables:
            raise BindProblem(f"duplicate name `{alias}`")
        self.tables[alias] = table

    def field(self, c: S.Col) -> Field:
        alias = c.table
        if alias is None:
            if len(self.tables) != 1:
                raise BindProblem(f"`{c.name}` must be qualified")
            alias = next(iter(self.tables))
        if alias not in self.tables:
            raise BindProblem(f"`{alias}` is not in scope")
        return Field(alias, c.name, self.tables[alias].type_of(c.name))


def typed(scope: Scope, e: Any, expected: Type | None = None, depth: int = 0) -> Any:
    """e with types; a literal takes the expected type, anything else must have it."""
    if depth > MOST_TYPING_DEPTH:
        raise BindProblem("the expression is nested too deep")
    if isinstance(e, S.Lit):
        if e.kind == "bool":
            if expected not in (None, BOOL):
                raise BindProblem(f"Bool where {expected} is expected")
            return Value(e.text == "true", BOOL)
        if expected is None:
            raise BindProblem(f"cannot resolve the type of literal {e.text}")
        return Value(literal(e.text, expected), expected)
    if isinstance(e, S.Param):
        if expected not in (None, IDENTITY, BYTES):
            raise BindProblem(f":sender cannot be a {expected}")
        return Sender(expected or IDENTITY)
    if isinstance(e, S.Col):
        found = scope.field(e)
        if expected and found.type != expected:
            raise BindProblem(f"{found.type} where {expected} is expected")
        return found
    if expected not in (None, BOOL):
        raise BindProblem(f"Bool where {expected} is expected")
    if isinstance(e, S.Logic):
        # chains lean left: walk them without recursion
        spine = [e]
        while isinstance(spine[-1].left, S.Logic):
            spine.append(spine[-1].left)
        left = typed(scope, spine[-1].left, BOOL, depth + 1)
        for link in reversed(spine):
            left = Both(link.op, left, typed(scope, link.right, BOOL, depth + 1))
        return left
    if isinstance(e, S.Cmp):
        if isinstance(e.left, (S.Lit, S.Param)):
            right = typed(scope, e.right, None, depth + 1)
            left = typed(scope, e.left, right.type, depth + 1)
        else:
            left = typed(scope, e.left, None, depth + 1)
            right = typed(scope, e.right, left.type, depth + 1)
        if not comparable(left.type):
            raise BindProblem(f"{e.op} does not take {left.type}")
        return Compare(e.op, left, right)
    raise BindProblem(f"not an expression: {e!r}")


def conjuncts(e: Any) -> Iterator[Any]:
    todo = [e] if e is not None else []
    while todo:
        x = todo.pop()
        if isinstance(x, Both) and x.op == "and":
            todo += [x.right, x.left]
        else:
            yield x


def bind_select(catalog: Catalog, s: S.Select, caller: bytes | None = None) -> Query:
    scope, joins = Scope(), []
    for r in s.relations:
        scope.add(r.alias, catalog.table(r.table, caller))
        if r.on:
            a, b = (scope.field(c) for c in r.on)
            if a.type != b.type:
                raise BindProblem(f"{a.type} is joined with {b.type}")
            if not comparable(a.type):
                raise BindProblem(f"= does not take {a.type}")
            joins.append((a, b))
    where = tuple(conjuncts(typed(scope, s.where, BOOL))) if s.where is not None else ()
    where += tuple(Compare("=", Field(alias, ARG_HASH, BYTES), SenderHash()) for alias, table in scope.tables.items() if table.per_sender)
    body = Fragment(tuple((r.alias, r.table) for r in s.relations), tuple(joins), where)
    if s.items == "*":
        if len(s.relations) > 1:
            raise BindProblem("SELECT * is not supported for joins")
        alias = s.relations[0].alias
        return Query((replace(body, out=alias),), table=s.relations[0].table, limit=s.limit)
    if isinstance(s.items, tuple) and s.items[0] == "*":
        if s.items[1] not in scope.tables:
            raise BindProblem(f"`{s.items[1]}` is not in scope")
        return Query((replace(body, out=s.items[1]),), table=scope.tables[s.items[1]].name, limit=s.limit)
    if isinstance(s.items, tuple):
        return Query((body,), count=s.items[1], limit=s.limit)
    names = [n for _, n in s.items]
    if len(set(names)) < len(names):
        raise BindProblem("two columns have one name")
    return Query((body,), columns=tuple((scope.field(c), n) for c, n in s.items), limit=s.limit)


def _assigned(e: Any, t: Type) -> Any:
    """The value for a column of type t; strings only fit strings here."""
    if isinstance(e, S.Lit) and e.kind == "str" and t != STRING:
        raise BindProblem(f"String where {t} is expected")
    if isinstance(e, S.Lit) and e.kind != "str" and t == STRING:
        raise BindProblem(f"{e.text} where String is expected")
    return typed(Scope(), e, t)


def bind(catalog: Catalog, sql: str, caller: bytes | None = None) -> Query | InsertPlan | DeletePlan | UpdatePlan | Variable:
    """Parses and binds any statement. caller None stands for the owner."""
    s = S.parse(sql)
    if isinstance(s, S.Select):
        return bind_select(catalog, s, caller)
    if isinstance(s, (S.SetVar, S.Show)):
        if s.name != "row_limit":
            raise BindProblem(f"unknown variable `{s.name}`")
        if isinstance(s, S.Show):
            return Variable(s.name)
        from tidewater.plans.types import U64

        if s.value.kind != "num":
            raise BindProblem("row_limit is a number")
        return Variable(s.name, int(literal(s.value.text, U64)))
    table = catalog.table(s.table, caller)
    if table.view:
        raise BindProblem(f"`{table.name}` is a view")
    if isinstance(s, S.Insert):
        kinds = list(table.columns.values())
        if s.columns and len(s.columns) != len(kinds):
            raise BindProblem(f"{len(s.columns)} columns where the table has {len(kinds)}")
        rows = []
        for row in s.rows:
            if len(row) != len(kinds):
                raise BindProblem(f"{len(row)} values for {len(kinds)} columns")
            rows.append(tuple(_assigned(v, t) for v, t in zip(row, kinds, strict=True)))  # in schema order, whatever the names
        return InsertPlan(table.name, tuple(rows))
    scope = Scope({table.name: table})
    where = typed(scope, s.where, BOOL) if s.where is not None else None
    if isinstance(s, S.Delete):
        return DeletePlan(table.name, where)
    values = tuple((c, _assigned(v, table.type_of(c))) for c, v in s.values)
    if len({c for c, _ in values}) < len(values):
        raise BindProblem("a column is assigned twice")
    return UpdatePlan(table.name, values, where)


def bind_subscription(catalog: Catalog, sql: str, caller: bytes | None = None) -> Query:
    return bind_select(catalog, S.parse_subscription(sql), caller)
