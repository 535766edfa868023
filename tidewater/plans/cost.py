"""Cardinality estimates from exact counts: admission by row limit, and kinds of scan."""

from __future__ import annotations

from tidewater.errors import LimitProblem
from tidewater.plans.catalog import Catalog, Index
from tidewater.plans.logical import Compare, Field, Fragment, Query, Sender, Value

TOP = (1 << 64) - 1


def _points(fragment: Fragment, alias: str) -> set[str]:
    """Columns of alias that are compared with a constant by =."""
    found = set()
    for w in fragment.where:
        if isinstance(w, Compare) and w.op == "=":
            for a, b in ((w.left, w.right), (w.right, w.left)):
                if isinstance(a, Field) and a.alias == alias and isinstance(b, (Value, Sender)):
                    found.add(a.column)
    return found


def _conditions(fragment: Fragment, alias: str) -> int:
    return sum(isinstance(s, Field) and s.alias == alias for w in fragment.where for s in (getattr(w, "left", w), getattr(w, "right", None)))


def _probe(catalog: Catalog, table: str, index: Index) -> int:
    keys = catalog.distinct(table, index.columns)
    return catalog.count(table) // keys if keys else 0


def access(catalog: Catalog, fragment: Fragment, alias: str) -> Index | None:
    """The index that constants of the fragment let a lookup of this relation use."""
    table = catalog.tables[fragment.table_of(alias)]
    fit = [i for i in table.indexes if len(i.columns) <= 3 and set(i.columns) <= _points(fragment, alias)]
    return max(fit, key=lambda i: (len(i.columns), i.unique), default=None)


def _leaf(catalog: Catalog, fragment: Fragment, alias: str) -> int:
    index = access(catalog, fragment, alias)
    table = fragment.table_of(alias)
    return _probe(catalog, table, index) if index else catalog.count(table)


def _join_columns(fragment: Fragment, alias: str, known: set[str]) -> set[str]:
    """Columns of alias that are joined with relations already there."""
    return {(a if a.alias == alias else b).column for a, b in fragment.joins if (a.alias == alias and b.alias in known) or (b.alias == alias and a.alias in known)}


def _steps(catalog: Catalog, fragment: Fragment) -> tuple[int, int]:
    """Rows out and rows scanned, joining from left to right."""
    known: set[str] = set()
    rows = scanned = 0
    for alias, table in fragment.relations:
        leaf = _leaf(catalog, fragment, alias)
        index = access(catalog, fragment, alias)
        filtered = _conditions(fragment, alias) > len(index.columns if index else ())
        own = min(TOP, leaf * (2 if filtered else 1))
        columns = _join_columns(fragment, alias, known)
        if not known:
            rows, scanned = leaf, own
        elif columns and catalog.tables[table].is_unique(columns):
            scanned = min(TOP, scanned + rows)
        elif columns and (joined := catalog.tables[table].index_on(columns)):
            rows = min(TOP, rows * _probe(catalog, table, joined))
            scanned = min(TOP, scanned + rows)
        else:
            rows = min(TOP, rows * leaf)
            scanned = min(TOP, scanned + own + rows)
        known.add(alias)
    return rows, scanned


def estimate(catalog: Catalog, query: Query) -> int:
    """Rows the body of a query is estimated to give."""
    return min(TOP, sum(_steps(catalog, f)[0] for f in query.fragments))


def scanned(catalog: Catalog, query: Query) -> int:
    return min(TOP, sum(_steps(catalog, f)[1] for f in query.fragments))


def admit(catalog: Catalog, query: Query, row_limit: int | None, exempt: bool = False) -> None:
    if row_limit is not None and not exempt and (rows := estimate(catalog, query)) > row_limit:
        raise LimitProblem(f"Estimated cardinality ({rows} rows) exceeds limit ({row_limit} rows)")


def scan_kind(catalog: Catalog, fragment: Fragment) -> str:
    """sequential, mixed, indexed_with_filter or fully_indexed."""
    indexed, full, known = False, False, set()
    filtered = False
    for alias, table in fragment.relations:
        index = access(catalog, fragment, alias)
        columns = _join_columns(fragment, alias, known)
        if index:
            indexed = True
        elif not (columns and catalog.tables[table].index_on(columns)):
            full = True
        filtered |= _conditions(fragment, alias) > len(index.columns if index else ())
        known.add(alias)
    if full:
        return "mixed" if indexed else "sequential"
    return "indexed_with_filter" if filtered else "fully_indexed"
