"""Subscriptions: snapshots, deltas per transaction, pruning, and a Structured Streaming driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.errors import BindProblem
from tidewater.functions import query_hash
from tidewater.operators import delta
from tidewater.operators.lower import Lowering, ref
from tidewater.plans import cost, security
from tidewater.plans.catalog import ARG_HASH, Catalog, sender_hash
from tidewater.plans.logical import Compare, Field, Fragment, Query, Value, bind, bind_subscription
from tidewater.plans.types import INTS, STRING
from tidewater.sources.files import numbered, remove, written


@dataclass
class Subscription:
    sql: str
    query: Query
    caller: bytes | None


#: SELECT * FROM *: all tables.
EVERYTHING = re.compile(r"\s*select\s+\*\s+from\s+\*\s*;?\s*", re.I)


def fold(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A table after a weighted delta, of which only what really changes it counts."""
    return delta.folded(state, delta.net(state, changes))


class Subscriptions:
    """The live queries of a database."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.active: dict[str, Subscription] = {}
        self.users: dict[str, int] = {}

    def subscribe(self, sql: str, caller: bytes | None = None) -> tuple[str, DataFrame]:
        """The query's id and its rows now. Equal queries are evaluated once."""
        query = security.secured(self.catalog, bind_subscription(self.catalog, sql, caller), caller)
        delta.check(self.catalog, query)
        key = query_hash(sql, caller)
        own = any(self.catalog.tables[t].rules or self.catalog.tables[t].per_sender for f in query.fragments for _, t in f.relations)
        if key not in self.active and own:
            key = query_hash(sql + ":sender", caller)  # what is seen depends on the caller
        self.active.setdefault(key, Subscription(sql, query, caller))
        self.users[key] = self.users.get(key, 0) + 1
        return key, Lowering(self.catalog, caller).query(query)

    def texts(self, sql: str) -> list[str]:
        """The statements that a subscription's text stands for: itself, or for SELECT * FROM * one for each table."""
        return [f'SELECT * FROM "{n}"' for n in self.catalog.visible_tables()] if EVERYTHING.fullmatch(sql) else [sql]

    def subscribe_all(self, caller: bytes | None = None) -> dict[str, tuple[str, DataFrame]]:
        """SELECT * FROM *, by table."""
        return {n: self.subscribe(sql, caller) for n, sql in zip(self.catalog.visible_tables(), self.texts("SELECT * FROM *"), strict=True)}

    def unsubscribe(self, key: str) -> DataFrame:
        """The rows that the client loses."""
        s = self.active[key]
        self.users[key] -= 1
        if not self.users[key]:
            del self.active[key], self.users[key]
        return Lowering(self.catalog, s.caller).query(s.query).withColumn("_op", F.lit("delete"))

    def apply(self, deltas: dict[str, DataFrame], suppress: bool = True) -> dict[str, DataFrame]:
        """One transaction (or, with _tx, several): moves the tables, and gives the change of each query that changes.
        What was there already or was not there to be deleted is no change. suppress: queries that do not
        change are left out, which takes a job for each that was not pruned."""
        tables = self.catalog.tables
        # written, as all that follows reads it more than once
        net = {n: d if tables[n].event else written(d, f"net-{n}") for n, d in self.netted(deltas).items()}
        after = {n: delta.folded(self.catalog.frames[n], d) for n, d in net.items() if not tables[n].event}
        out = self.changed(net, after)
        out = {k: c for k, c in out.items() if not suppress or not c.isEmpty()}
        for name, frame in after.items():
            if name in net:
                self.catalog.move(name, frame, net[name].drop(delta.TX))
            else:
                self.catalog.put(name, frame)  # a view
        return out

    def netted(self, deltas: dict[str, DataFrame]) -> dict[str, DataFrame]:
        tables = self.catalog.tables
        return {n: d if tables[n].event else delta.net(self.catalog.frames[n], d) for n, d in deltas.items()}

    def changed(self, net: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The change of every query that net deltas can concern; the catalogue still holds the states before.
        after: the changed tables' states after it; the views that read them are added to it."""
        net = dict(net)
        states = self.catalog.frames | after
        for name, table in self.catalog.tables.items():
            if table.view and table.reads & net.keys():
                before = self.catalog.frames[name]
                states[name] = after[name] = self.catalog.evaluated(table.sql, table.procedure, states)[0]
                query = bind(self.catalog, table.sql) if table.sql else None
                if query and query.table and query.limit is None and all(len(f.relations) <= 2 for f in query.fragments):
                    net[name] = delta.change(self.catalog, query, net, before=True)
                else:  # what a procedure, or a query with a limit, gave before and gives now
                    net[name] = delta.weighted(after[name].exceptAll(before), before.exceptAll(after[name]))
        found = {key: s for key, s in self.active.items() if any(t in net for f in s.query.fragments for _, t in f.relations)}
        found = {key: found[key] for key in self._concerned(found, net)}
        if any(delta.TX in d.columns for d in net.values()) and any(delta.TX not in d.columns for d in net.values()):
            net = {n: d if delta.TX in d.columns else d.withColumn(delta.TX, F.lit(None).cast("long")) for n, d in net.items()}
        return {key: delta.change(self.catalog, s.query, net, s.caller, before=True) for key, s in found.items()}

    # -- which queries a delta can concern at all

    def search_arguments(self) -> list[tuple[str, str, str, str]]:
        """(query, table, column, value) of live queries over one table that ask for column = value."""
        out = []
        for key, s in self.active.items():
            for f in s.query.fragments:
                for w in f.where if len(f.relations) == 1 else ():
                    if isinstance(w, Compare) and w.op == "=" and isinstance(w.left, Field) and isinstance(w.right, Value):
                        out.append((key, f.relations[0][1], w.left.column, str(w.right.value)))
        return out


    def _concerned(self, found: dict[str, Subscription], net: dict[str, DataFrame]) -> list[str]:
        """The queries that some changed row can matter to. A fragment changes only if a changed row of one of its
        relations meets what the fragment asks of that relation: column = value there, or, over a join with a
        unique key of a table that did not change, column = value in that table."""
        keep: set[str] = set()
        values: dict[str, list[tuple[str, str, str]]] = {}
        edges: dict[tuple[str, str, str, str, str], list[tuple[str, str]]] = {}
        for key, s in found.items():
            asked = [self._asked(f, a, net) for f in s.query.fragments for a, t in f.relations if t in net]
            if not all(asked):
                keep.add(key)
                continue
            for kind, place, value in asked:
                if kind == "value":
                    values.setdefault(place[0], []).append((key, place[1], value))
                else:
                    edges.setdefault(place, []).append((key, value))
        make = self.catalog.spark.createDataFrame
        parts = [pruned_by_value(net[t], make(rows, "query_id string, column string, value string")) for t, rows in values.items()]
        parts += [pruned_by_edge(net[t], c, self.catalog.frames[other], k, oc, make(rows, "query_id string, value string")) for (t, c, other, k, oc), rows in edges.items()]
        if parts:  # as many rows as there are queries, at most
            keep |= {r[0] for r in reduce(DataFrame.unionByName, parts).distinct().collect()}
        return [key for key in found if key in keep]

    def _asked(self, f: Fragment, alias: str, net: dict[str, DataFrame]) -> tuple[str, tuple, str] | None:
        """What a fragment asks of the rows of a relation, where that can be told by equal text."""

        def constant(of: str) -> tuple[str, str] | None:
            for w in f.where:
                if isinstance(w, Compare) and w.op == "=":
                    for a, b in ((w.left, w.right), (w.right, w.left)):
                        if isinstance(a, Field) and a.alias == of and isinstance(b, Value) and (a.type == STRING or a.type.name in INTS and INTS[a.type.name][1] <= 64):
                            return a.column, str(b.value)
            return None

        table = f.table_of(alias)
        if found := constant(alias):
            return "value", (table, found[0]), found[1]
        for x, y in f.joins:
            for a, b in ((x, y), (y, x)):
                other = f.table_of(b.alias)
                if a.alias == alias != b.alias and other not in net and self.catalog.tables[other].is_unique({b.column}) and (found := constant(b.alias)):
                    return "edge", (table, a.column, other, b.column, found[0]), found[1]
        return None


class Client:
    """One client's subscriptions: a set that ``subscribe`` replaces, and others by the ids that the client gives."""

    def __init__(self, subscriptions: Subscriptions, caller: bytes | None = None) -> None:
        self.subscriptions, self.caller = subscriptions, caller
        self.sets: dict[int | None, list[str]] = {}

    def subscribe(self, queries: list[str]) -> list[DataFrame]:
        """Replaces the unnamed set. Rows of every query, also those that the set before had."""
        if None in self.sets:
            self.unsubscribe(None)
        return self.subscribe_multi(None, queries)

    def subscribe_multi(self, query_id: int | None, queries: list[str]) -> list[DataFrame]:
        """Rows of every query; a row that several give comes several times. All are in the set, or none."""
        if query_id in self.sets:
            raise BindProblem(f"the query id {query_id} is in use")
        keys, rows = [], []
        try:
            for sql in (t for q in queries for t in self.subscriptions.texts(q)):
                key, found = self.subscriptions.subscribe(sql, self.caller)
                keys.append(key)
                rows.append(found)
        except Exception:
            for key in keys:
                self.subscriptions.unsubscribe(key)
            raise
        self.sets[query_id] = keys
        return rows

    def subscribe_single(self, query_id: int, sql: str) -> DataFrame:
        if EVERYTHING.fullmatch(sql):
            raise BindProblem("SELECT * FROM * stands for several queries")
        return self.subscribe_multi(query_id, [sql])[0]

    def unsubscribe(self, query_id: int | None) -> list[DataFrame]:
        """The rows that go, query by query."""
        if query_id not in self.sets:
            raise BindProblem(f"there is no query id {query_id}")
        return [self.subscriptions.unsubscribe(key) for key in self.sets.pop(query_id)]

    def one_off(self, sql: str) -> DataFrame:
        """The rows of a query now, without a subscription."""
        query = security.secured(self.subscriptions.catalog, bind_subscription(self.subscriptions.catalog, sql, self.caller), self.caller)
        return Lowering(self.subscriptions.catalog, self.caller).query(query)

    def updates(self, changes: dict[str, DataFrame]) -> dict[int | None, list[DataFrame]]:
        """This client's part of what apply gave, by query id."""
        found = {i: [changes[k] for k in keys if k in changes] for i, keys in self.sets.items()}
        return {i: c for i, c in found.items() if c}


def pruned_by_value(changes: DataFrame, arguments: DataFrame) -> DataFrame:
    """query_id of the queries whose column = value some changed row meets. arguments: query_id, column, value (as
    text); there are as many rows as queries, which the join may broadcast by its size."""
    columns = [c for c in changes.columns if c != delta.WEIGHT]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value")) for c in columns if c in _named(arguments)])
    seen = changes.select(F.explode(cells).alias("cell")).select("cell.*").distinct()
    return seen.join(arguments, ["column", "value"]).select("query_id").distinct()


def _named(arguments: DataFrame) -> set[str]:
    return {r[0] for r in arguments.select("column").distinct().collect()}


def pruned_by_edge(changes: DataFrame, column: str, other: DataFrame, other_key: str, other_column: str, arguments: DataFrame) -> DataFrame:
    """The same for queries that join the changed table's column with a unique other_key and ask for
    other_column = value there: two lookups. arguments: query_id, value."""
    reached = changes.select(ref(column).alias("_k")).distinct().join(other.select(ref(other_key).alias("_k"), ref(other_column).cast("string").alias("value")), "_k")
    return reached.select("value").distinct().join(arguments, "value").select("query_id").distinct()


def sender_view(rows: DataFrame, caller_column: str) -> DataFrame:
    """A view kept per caller: its rows with the hash of the caller (an identity) that they are for. Added to a
    catalogue with ``per_sender``, every query of it asks for the part of its own caller."""
    return rows.withColumn(ARG_HASH, F.unhex(F.sha2(ref(caller_column).cast("binary"), 256)))


def of_sender(view: DataFrame, caller: bytes) -> DataFrame:
    return view.where(F.col(ARG_HASH) == F.lit(sender_hash(caller))).drop(ARG_HASH)


#: What a stream of transactions carries: one row for each changed row, as JSON.
STREAM = "_tx bigint, _table string, _w bigint, row string"


class LiveStream:
    """Runs subscriptions over a stream of STREAM rows (JSON files in a folder). A transaction is the rows of one
    _tx (null: 0); transactions take effect in the order of their numbers, those of one micro-batch in one pass, and one
    must not be spread over several files of different micro-batches.

    Under ``out``, by batch number: log/<table> holds the net delta, changes/<query> what changed of each query
    that did, by _tx, and, every COMPACT batches of a table, state/<table> its rows. A table's state is its last
    written one (at first: the rows in the catalogue, which must be the same after a restart) with the deltas since; so
    a batch costs in proportion to its changes and a scan. A batch that is run again, also after a restart, starts from the state
    before it and overwrites its own results.
    """

    COMPACT = 16

    def __init__(self, subscriptions: Subscriptions, out: str) -> None:
        self.subscriptions, self.out = subscriptions, out.rstrip("/")
        self.first = dict(subscriptions.catalog.frames)
        self.at: int | None = None  # the batch whose state the catalogue holds

    def _stored(self, name: str, number: int) -> tuple[int, list[int]]:
        """The last written state of a table before batch number (-1: none), and the deltas from there to it."""
        spark = self.subscriptions.catalog.spark
        base = max((n for n in numbered(spark, f"{self.out}/state/{name}") if n < number), default=-1)
        return base, [n for n in numbered(spark, f"{self.out}/log/{name}") if base < n < number]

    def _state(self, name: str, number: int) -> DataFrame:
        """A table's rows before batch number."""
        first, spark = self.first[name], self.subscriptions.catalog.spark
        base, log = self._stored(name, number)
        rows = first if base < 0 else spark.read.schema(first.schema).parquet(f"{self.out}/state/{name}/{base}")
        if not log:
            return rows
        return delta.folded(rows, self._log(name, first, log))

    def _log(self, name: str, first: DataFrame, numbers: list[int]) -> DataFrame:
        schema = first.withColumn(delta.TX, F.lit(0).cast("long")).withColumn(delta.WEIGHT, F.lit(0).cast("long")).schema
        return self.subscriptions.catalog.spark.read.schema(schema).parquet(*[f"{self.out}/log/{name}/{n}" for n in numbers])

    def _restore(self, number: int) -> None:
        """The catalogue as it was before batch number."""
        catalog = self.subscriptions.catalog
        for name, table in catalog.tables.items():
            if not table.event and not table.view:
                catalog.put(name, self._state(name, number))
        for name, table in catalog.tables.items():
            if table.reads:
                catalog.put(name, catalog.evaluated(table.sql, table.procedure, catalog.frames)[0])

    def _batch(self, rows: DataFrame, number: int) -> None:
        catalog = self.subscriptions.catalog
        if self.at is None or number != self.at + 1:
            self._restore(number)
        rows = rows.withColumn(delta.TX, F.coalesce(delta.TX, F.lit(0).cast("long"))).persist()
        try:
            names = [r[0] for r in rows.select("_table").distinct().collect() if r[0] in catalog.tables and not catalog.tables[r[0]].view]
            deltas = {}
            for n in names:
                mine = rows.where(F.col("_table") == n).select(F.from_json("row", catalog.frames[n].schema).alias("r"), delta.TX, delta.WEIGHT)
                deltas[n] = mine.select("r.*", delta.TX, delta.WEIGHT)
            net = {}
            for n, d in self.subscriptions.netted(deltas).items():
                d.write.mode("overwrite").parquet(f"{self.out}/log/{n}/{number}")
                net[n] = self._log(n, self.first[n], [number])
            after = {n: self._state(n, number + 1) for n in names if not catalog.tables[n].event}
            for key, c in self.subscriptions.changed(net, after).items():
                path = f"{self.out}/changes/{key}/batch={number}"
                c.write.mode("overwrite").parquet(path)
                if catalog.spark.read.parquet(path).isEmpty():  # no change, no message
                    remove(catalog.spark, path)
            for n, frame in after.items():
                catalog.put(n, frame)
            for n in names:
                self._compact(n, number)
        finally:
            rows.unpersist()
        self.at = number

    def _compact(self, name: str, number: int) -> None:
        catalog = self.subscriptions.catalog
        base, log = self._stored(name, number + 1)
        if catalog.tables[name].event or len(log) < self.COMPACT:
            return
        path = f"{self.out}/state/{name}/{number}"
        catalog.frames[name].write.mode("overwrite").parquet(path)
        catalog.put(name, catalog.spark.read.schema(self.first[name].schema).parquet(path))
        # this batch may be run again, so what it started from stays until the next time
        for n in numbered(catalog.spark, f"{self.out}/state/{name}"):
            if n < base:
                remove(catalog.spark, f"{self.out}/state/{name}/{n}")
        for n in numbered(catalog.spark, f"{self.out}/log/{name}"):
            if n <= base:
                remove(catalog.spark, f"{self.out}/log/{name}/{n}")

    def start(self, spark: SparkSession, folder: str, files_per_batch: int = 1) -> StreamingQuery:
        source = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", files_per_batch).json(folder)
        return source.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.out}/checkpoint").trigger(availableNow=True).start()

    def changes(self, spark: SparkSession, key: str) -> DataFrame:
        """All changes of a query so far, with the batch and transaction that made them."""
        if not numbered(spark, f"{self.out}/changes/{key}"):
            s = self.subscriptions
            none = delta.change(s.catalog, s.active[key].query, {}).withColumn(delta.TX, F.lit(0).cast("long"))
            return none.withColumn("batch", F.lit(0)).limit(0)
        return spark.read.parquet(f"{self.out}/changes/{key}")


def scan_kinds(subscriptions: Subscriptions) -> dict[str, list[str]]:
    return {k: [cost.scan_kind(subscriptions.catalog, f) for f in s.query.fragments] for k, s in subscriptions.active.items()}


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
