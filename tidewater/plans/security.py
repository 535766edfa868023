"""Row-level security as a rewrite of fragments.

A restricted table is replaced by each of its rules in turn, so a fragment becomes as many as its
tables' rules multiply to; their rows are added up without removing duplicates. A rule's own return table is
not restricted again inside that rule.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import count

from tidewater.errors import AccessProblem, BindProblem
from tidewater.plans import syntax as S
from tidewater.plans.catalog import Catalog
from tidewater.plans.logical import Both, Compare, Field, Fragment, Query, bind_select


def add_rule(catalog: Catalog, sql: str) -> str:
    """Attaches a visibility rule to the table whose rows it returns; the table's name."""
    query = bind_select(catalog, S.parse_subscription(sql))
    for fragment in query.fragments:
        for _, table in fragment.relations:
            if not catalog.tables[table].public:
                raise AccessProblem(f"a rule may not read the private table `{table}`")
    assert query.table
    catalog.tables[query.table].rules.append(sql)
    return query.table


def _renamed(e, names: dict[str, str]):
    if isinstance(e, Field):
        return replace(e, alias=names.get(e.alias, e.alias))
    if isinstance(e, (Compare, Both)):
        return replace(e, left=_renamed(e.left, names), right=_renamed(e.right, names))
    return e


def _spliced(fragment: Fragment, alias: str, rule: Fragment, numbers) -> Fragment:
    """fragment with the relation alias narrowed by rule, whose other relations get fresh names."""
    names = {a: alias if a == rule.out else f"{a}_{next(numbers)}" for a, _ in rule.relations}
    more = tuple((names[a], t) for a, t in rule.relations if a != rule.out)
    joins = tuple((_renamed(a, names), _renamed(b, names)) for a, b in rule.joins)
    return replace(fragment, relations=fragment.relations + more, joins=fragment.joins + joins, where=fragment.where + tuple(_renamed(w, names) for w in rule.where))


def _rules_of(catalog: Catalog, table: str, stack: tuple[str, ...], numbers) -> list[Fragment]:
    """The rules of a table with everything they read restricted too; none: the table is open."""
    if table in stack:
        raise BindProblem(f"the rules of `{table}` are cyclic")
    out = []
    for sql in catalog.tables[table].rules:
        for fragment in bind_select(catalog, S.parse_subscription(sql)).fragments:
            out += _expanded(catalog, fragment, (*stack, table), numbers, skip=fragment.out)
    return out


def _expanded(catalog: Catalog, fragment: Fragment, stack: tuple[str, ...], numbers, skip: str | None = None) -> list[Fragment]:
    found = [fragment]
    for alias, table in fragment.relations:
        if alias == skip:
            continue
        rules = _rules_of(catalog, table, stack, numbers) if catalog.tables[table].rules else []
        if rules:
            found = [_spliced(f, alias, r, numbers) for f in found for r in rules]
    return found


def secured(catalog: Catalog, query: Query, caller: bytes | None) -> Query:
    """query as caller may run it; the owner (or None) sees everything."""
    if caller is None or caller == catalog.owner:
        return query
    numbers = count(2)
    return replace(query, fragments=tuple(x for f in query.fragments for x in _expanded(catalog, f, (), numbers)))
