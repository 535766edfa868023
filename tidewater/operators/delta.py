"""Live results: the change of a query's rows from the change of its tables, as bags.

A delta is a table's rows with a weight _w, +1 inserted, -1 deleted. For R join S with the states after the change:
dV = R' x dS  +  dR x S'  -  dR x dS,  and with those before it:  dV = R x dS  +  dR x S  +  dR x dS.  Adding up
weights over equal rows cancels what came and went; what is left is inserted that often, or deleted that often.

Deltas of many transactions may go through at once, told apart by _tx. Over the states before the first of them
a pair of dR and dS belongs to the later of its two transactions, so one pass gives the change of each.

Tables are sets, and a net delta holds only what changes them: rows that come and were not there, and rows that
go and were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.errors import BindProblem
from tidewater.operators.changes import same
from tidewater.operators.lower import Lowering, name_of, ref
from tidewater.plans.catalog import Catalog
from tidewater.plans.logical import Fragment, Query
from tidewater.plans.cost import _join_columns

WEIGHT, TX = "_w", "_tx"


def weighted(inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """A table's delta from the rows a transaction inserted and deleted."""
    return inserts.withColumn(WEIGHT, F.lit(1).cast("long")).unionByName(deletes.withColumn(WEIGHT, F.lit(-1).cast("long")))


def check(catalog: Catalog, query: Query) -> None:
    """What a subscription may be: fragments of one table, or of two joined by indexed columns, the looked-up
    side not an event table."""
    if query.table is None or query.limit is not None:
        raise BindProblem("a live query returns whole rows without LIMIT")
    for f in query.fragments:
        if len(f.relations) > 2:
            raise BindProblem("a live query joins at most two tables")
        if len(f.relations) == 2:
            if not f.joins:
                raise BindProblem("a live query needs a join on equal columns")
            aliases = [a for a, _ in f.relations]
            for alias in aliases:
                table = catalog.tables[f.table_of(alias)]
                columns = _join_columns(f, alias, set(aliases) - {alias})
                if not table.index_on(columns):
                    raise BindProblem(f"`{table.name}` needs an index on {sorted(columns)} for this live query")
            if catalog.tables[f.relations[1][1]].event:
                raise BindProblem("an event table cannot be looked up in a live join")


def consolidated(changes: DataFrame) -> DataFrame:
    """Equal rows (of one transaction) once, with the sum of their weights; zeros go."""
    columns = [c for c in changes.columns if c != WEIGHT]
    return changes.groupBy(*[ref(c) for c in columns]).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def net(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The net delta: what changes really change of a table that is a set, transaction by transaction if they have
    _tx. Work goes with the changes; the state is scanned once, with the changed rows broadcast if they are small
    by Catalyst's statistics."""
    columns = state.columns
    ops = consolidated(changes)
    rows = ops.select(*[ref(c) for c in columns]).distinct()
    there = state.join(rows, same(state, rows, columns), "left_semi").distinct()
    known = there.select(*[ref(c).alias(f"_there_{c}") for c in columns], F.lit(True).alias("_there"))
    on = reduce(lambda a, b: a & b, [ref(c).eqNullSafe(ref(f"_there_{c}")) for c in columns])
    ops = ops.join(known, on, "left")
    before = F.coalesce(ref("_there"), F.lit(False))
    if TX in ops.columns:  # after an earlier operation on the row it is there if that was an insert
        before = F.coalesce(F.lag(F.col(WEIGHT) > 0).over(Window.partitionBy(*[ref(c) for c in columns]).orderBy(TX)), before)
    came = F.col(WEIGHT) > 0
    kept = ops.withColumn("_before", before).where(came != F.col("_before"))
    return kept.select(*[ref(c) for c in changes.columns if c != WEIGHT], F.when(came, 1).otherwise(-1).cast("long").alias(WEIGHT))


def folded(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A table after a net delta (of any number of transactions: their weights add up)."""
    total = consolidated(changes.drop(TX))
    gone, came = total.where("_w < 0").drop(WEIGHT), total.where("_w > 0").drop(WEIGHT)
    return state.join(gone, same(state, gone, state.columns), "left_anti").unionByName(came)


def _rows(catalog: Catalog, f: Fragment, table: str, frames: dict[str, DataFrame], sign: int, caller: bytes | None) -> DataFrame:
    """The fragment over given frames; the weights of those that are deltas are multiplied."""
    deltas = list(frames)
    for alias, name in f.relations:
        if alias not in frames and catalog.tables[name].event:  # has no state
            frames = frames | {alias: catalog.frames[name].limit(0)}
    body = Lowering(catalog, caller, frames).body(f)
    weight = reduce(lambda a, b: a * b, [ref(name_of(a, WEIGHT)) for a in deltas], F.lit(sign).cast("long"))
    columns = [ref(name_of(f.out, c)).alias(c) for c in catalog.tables[table].visible]
    if all(TX in frames[a].columns for a in deltas):
        tx = [ref(name_of(a, TX)) for a in deltas]
        columns.append((F.greatest(*tx) if len(tx) > 1 else tx[0]).alias(TX))
    return body.select(*columns, weight.alias(WEIGHT))


def change(catalog: Catalog, query: Query, deltas: dict[str, DataFrame], caller: bytes | None = None, before: bool = False) -> DataFrame:
    """The consolidated change of a query (its rows, _w, and _tx if the deltas have it), from net deltas by table.
    The catalogue holds the states after the change, or, as it must for deltas with _tx, those before."""
    assert query.table
    parts = []
    for f in query.fragments:
        aliases = [a for a, _ in f.relations]
        touched = [a for a, t in f.relations if t in deltas]
        for a in touched:
            parts.append(_rows(catalog, f, query.table, {a: deltas[f.table_of(a)]}, 1, caller))
        if len(aliases) > 2:
            raise BindProblem("deltas are kept for at most two tables")
        if len(touched) == 2:
            parts.append(_rows(catalog, f, query.table, {a: deltas[f.table_of(a)] for a in touched}, 1 if before else -1, caller))
    if not parts:
        frame = catalog.frames[query.table].select(*catalog.tables[query.table].visible)
        return frame.withColumn(WEIGHT, F.lit(0).cast("long")).limit(0)
    return consolidated(reduce(DataFrame.unionByName, parts))


def inserted(changes: DataFrame) -> DataFrame:
    """The rows a change adds, as often as it adds them."""
    return _repeated(changes.where(F.col(WEIGHT) > 0))


def deleted(changes: DataFrame) -> DataFrame:
    return _repeated(changes.where(F.col(WEIGHT) < 0))


def _repeated(changes: DataFrame) -> DataFrame:
    columns = [ref(c) for c in changes.columns if c not in (WEIGHT, TX)]
    return changes.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.abs(WEIGHT))).alias("_i")).drop("_i")


def cache_changes(before: DataFrame, changes: DataFrame) -> DataFrame:
    """What a client sees, which shows equal rows once: rows whose count leaves or reaches zero, with _op insert or
    delete. before: the bag of rows known (without counts)."""
    columns = [ref(c) for c in before.columns]
    counts = before.groupBy(*columns).agg(F.count(F.lit(1)).alias("old")).withColumn("d", F.lit(0).cast("long"))
    moved = changes.groupBy(*columns).agg(F.sum(WEIGHT).alias("d")).withColumn("old", F.lit(0).cast("long"))
    both = counts.unionByName(moved).groupBy(*columns).agg(F.sum("old").alias("old"), F.sum("d").alias("d"))
    op = F.when((F.col("old") == 0) & (F.col("d") > 0), "insert").when((F.col("old") > 0) & (F.col("old") + F.col("d") <= 0), "delete")
    return both.withColumn("_op", op).where("_op is not null").select(*columns, "_op")


def cache(rows: DataFrame) -> DataFrame:
    """The rows a client shows: each once."""
    return rows.distinct()


def updates(inserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Events by primary key: insert, delete, or update where the key was both deleted and inserted; old and new are
    the rows (structs, null where there is none)."""
    old = deletes.select(ref(key).alias("_old_key"), F.struct(*[ref(c) for c in deletes.columns]).alias("old"))
    new = inserts.select(ref(key).alias("_new_key"), F.struct(*[ref(c) for c in inserts.columns]).alias("new"))
    both = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer")
    op = F.when(F.col("_old_key").isNull(), "insert").when(F.col("_new_key").isNull(), "delete").otherwise("update")
    return both.select(F.coalesce("_new_key", "_old_key").alias("key"), op.alias("_op"), "old", "new")
