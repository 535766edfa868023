"""Inserts, deletes and updates as functions from a table's rows to its new rows. Tables are sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import ConstraintProblem
from tidewater.operators.lower import Lowering, constant, name_of, ref
from tidewater.plans.catalog import Catalog, Table
from tidewater.plans.logical import DeletePlan, InsertPlan, Sender, UpdatePlan, Value
from tidewater.plans.types import literal


def same(a: DataFrame, b: DataFrame, columns: list[str]):
    return reduce(lambda x, y: x & y, [a[f"`{c}`"].eqNullSafe(b[f"`{c}`"]) for c in columns])


def added(state: DataFrame, rows: DataFrame) -> DataFrame:
    """rows that are not in state yet, each once. Catalyst broadcasts rows if they are small by its statistics (as
    the delta of a transaction is), and shuffles both sides if not."""
    rows = rows.select(*state.columns).dropDuplicates()
    there = state.join(rows, same(state, rows, state.columns), "left_semi").distinct()
    return rows.exceptAll(there)


def insert(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.unionByName(added(state, rows))


def _condition(catalog: Catalog, table: str, where, caller: bytes | None):
    """where as a column over the plain table."""
    state = catalog.frames[table]
    named = state.select(*[ref(c).alias(name_of(table, c)) for c in state.columns])
    condition = Lowering(catalog, caller).expression(where, dict(named.dtypes)) if where is not None else F.lit(True)
    return named, condition


def _plain(catalog: Catalog, table: str, named: DataFrame) -> DataFrame:
    return named.select(*[ref(name_of(table, c)).alias(c) for c in catalog.frames[table].columns])


def matched(catalog: Catalog, table: str, where, caller: bytes | None = None) -> DataFrame:
    """The rows a DELETE or UPDATE concerns. A condition that is null, since a column is, does not hold."""
    named, condition = _condition(catalog, table, where, caller)
    return _plain(catalog, table, named.where(condition))


def unmatched(catalog: Catalog, table: str, where, caller: bytes | None = None) -> DataFrame:
    """All other rows."""
    named, condition = _condition(catalog, table, where, caller)
    return _plain(catalog, table, named.where(~F.coalesce(condition, F.lit(False))))


def delete(catalog: Catalog, plan: DeletePlan, caller: bytes | None = None) -> DataFrame:
    return unmatched(catalog, plan.table, plan.where, caller)


def _assigned(catalog: Catalog, plan: UpdatePlan, caller: bytes | None) -> dict[str, Column]:
    kinds = dict(catalog.frames[plan.table].dtypes)
    owner = caller if caller is not None else catalog.owner
    return {c: F.lit(owner) if isinstance(v, Sender) else constant(v.value, v.type, kinds[c]) for c, v in plan.values}


def keyed(table: Table, assigned: set[str]) -> bool:
    """Whether a unique key outside the assigned columns keeps changed rows apart."""
    return any(i.unique and not set(i.columns) & assigned for i in table.indexes)


def update(catalog: Catalog, plan: UpdatePlan, caller: bytes | None = None) -> DataFrame:
    """The filter is evaluated on the old rows. Rows that become equal collapse, which costs a shuffle only if the
    table has no key outside the assigned columns."""
    named, condition = _condition(catalog, plan.table, plan.where, caller)
    new = _assigned(catalog, plan, caller)
    out = []
    for c in catalog.frames[plan.table].columns:
        old = ref(name_of(plan.table, c))
        out.append((F.when(condition, new[c]).otherwise(old) if c in new else old).alias(c))
    result = named.select(*out)
    return result if keyed(catalog.tables[plan.table], set(new)) else result.dropDuplicates()


def updated(catalog: Catalog, plan: UpdatePlan, caller: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """The net change of an UPDATE, from the rows it concerns: rows that come and rows that go."""
    before = matched(catalog, plan.table, plan.where, caller)
    new = _assigned(catalog, plan, caller)
    moved = F.lit(False)
    for c, v in new.items():
        moved = moved | ~ref(c).eqNullSafe(v)
    gone = before.where(moved)
    came = gone.select(*[new[c].alias(c) if c in new else ref(c) for c in before.columns])
    if keyed(catalog.tables[plan.table], set(new)):
        return came, gone
    still = before.where(~moved).unionByName(unmatched(catalog, plan.table, plan.where, caller))
    return added(still, came), gone


def _literals(catalog: Catalog, plan: InsertPlan, caller: bytes | None) -> tuple[list[tuple], T.StructType]:
    """The VALUES of an INSERT, equal rows once; a 0 in the sequence column asks for the next number."""
    state, table = catalog.frames[plan.table], catalog.tables[plan.table]
    rows = [[(caller or catalog.owner) if isinstance(v, Sender) else v.value for v in row] for row in plan.rows]
    if table.sequence:
        at, kind = list(table.columns).index(table.sequence), table.columns[table.sequence]
        for r in rows:
            if r[at] == literal("0", kind):
                r[at] = literal(str(catalog.next_number(plan.table)), kind)
    fields = [T.StructField(f.name, f.dataType, True) for f in state.schema.fields]
    plain = [tuple(v.replace(tzinfo=None) if isinstance(f.dataType, T.TimestampNTZType) else v for v, f in zip(r, fields, strict=True)) for r in rows]
    return list(dict.fromkeys(plain)), T.StructType(fields)


def literal_rows(catalog: Catalog, plan: InsertPlan, caller: bytes | None = None) -> DataFrame:
    """The rows that an INSERT of literals adds: those that are not there yet. One scan of the table, with the literals
    broadcast; the rows found are at most one for each literal and unique index, or one a literal. Rows that would
    have another's unique key are refused."""
    spark, table = catalog.spark, catalog.tables[plan.table]
    rows, schema = _literals(catalog, plan, caller)
    state = catalog.frames[plan.table]
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*schema.fields, T.StructField("_row", T.IntegerType(), True)]))
    numbered = F.broadcast(numbered.select(*[ref(c).alias(f"_new_{c}") for c in state.columns], "_row"))
    equal = lambda columns: reduce(lambda x, y: x & y, [ref(c).eqNullSafe(ref(f"_new_{c}")) for c in columns])
    unique = [i for i in table.indexes if i.unique]
    found = [state.join(numbered, equal(i.columns)).select("_row", F.lit(n).alias("_index"), equal(state.columns).alias("_same")) for n, i in enumerate(unique)]
    found = found or [state.join(numbered, equal(state.columns)).select("_row", F.lit(0).alias("_index"), F.lit(True).alias("_same"))]
    there = reduce(DataFrame.unionByName, found).distinct().collect()
    known = {r["_row"] for r in there if r["_same"]}
    fresh = [r for i, r in enumerate(rows) if i not in known]
    for r in there:
        if not r["_same"] and r["_row"] not in known:
            raise _conflict(table, unique[r["_index"]].columns, rows[r["_row"]])
    for i in unique:
        keys = [tuple(r[state.columns.index(c)] for c in i.columns) for r in fresh]
        if len(set(keys)) < len(keys):
            raise _conflict(table, i.columns, next(r for n, r in enumerate(fresh) if keys.index(keys[n]) < n))
    return spark.createDataFrame(fresh, schema)


def _conflict(table: Table, columns: tuple[str, ...], row: tuple) -> ConstraintProblem:
    values = dict(zip(table.columns, row, strict=True))
    return ConstraintProblem(f"`{table.name}` already has a row with {', '.join(f'{c} = {values[c]}' for c in columns)}")


def check_unique(table: Table, rest: DataFrame, fresh: DataFrame, assigned: set[str]) -> None:
    """Refuses what an UPDATE of the assigned columns gives, if a row's key of a unique index is that of another or
    of one of the rest. A job, and a scan of the key columns, for each unique index with an assigned column."""
    for i in table.indexes:
        if not i.unique or not set(i.columns) & assigned:
            continue
        columns = [ref(c) for c in i.columns]
        keys = fresh.select(*columns)
        twice = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*columns)
        known = rest.select(*columns)
        again = known.join(keys, same(known, keys, list(i.columns)), "left_semi")
        if found := twice.unionByName(again).limit(1).collect():
            raise ConstraintProblem(f"`{table.name}` already has a row with {', '.join(f'{c} = {v}' for c, v in found[0].asDict().items())}")


def violations(state: DataFrame, table: Table) -> DataFrame:
    """Keys of unique indexes that several rows have: index, key (as JSON), n."""
    parts = [state.groupBy(*i.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(",".join(i.columns)).alias("index"), F.to_json(F.struct(*i.columns)).alias("key"), "n") for i in table.indexes if i.unique]
    return reduce(DataFrame.unionByName, parts) if parts else state.sparkSession.createDataFrame([], "index string, key string, n bigint")


def values_of(plan: InsertPlan) -> list[tuple]:
    return [tuple(v.value if isinstance(v, Value) else None for v in row) for row in plan.rows]
