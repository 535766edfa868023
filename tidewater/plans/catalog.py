"""What the engine knows of tables: columns, keys, indexes, access, rules, views."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import AccessProblem, BindProblem
from tidewater.plans.types import INTS, Type, of_spark, wide_int
from tidewater.sources.files import written


@dataclass(frozen=True)
class Index:
    columns: tuple[str, ...]
    unique: bool = False
    kind: str = "btree"  # or hash, direct: points only, or dense integers


@dataclass
class Table:
    name: str
    columns: dict[str, Type]
    primary_key: str | None = None
    indexes: list[Index] = field(default_factory=list)
    public: bool = True
    event: bool = False
    view: bool = False
    hidden: tuple[str, ...] = ()  # private columns of a view: not in *
    rules: list[str] = field(default_factory=list)
    sequence: str | None = None  # auto-increment column
    per_sender: bool = False  # a view kept per caller, by the column ARG_HASH
    sql: str | None = None  # of a query view
    procedure: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None  # of a procedural view
    reads: frozenset[str] = frozenset()  # tables that a view was seen to read
    rows: int | None = None  # for estimates; counted when first needed

    def __post_init__(self) -> None:
        if self.primary_key and not any(i.columns == (self.primary_key,) and i.unique for i in self.indexes):
            self.indexes.insert(0, Index((self.primary_key,), unique=True))

    def type_of(self, column: str) -> Type:
        if column not in self.columns:
            raise BindProblem(f"`{column}` is not in scope")
        return self.columns[column]

    @property
    def visible(self) -> list[str]:
        return [c for c in self.columns if c not in self.hidden and not (self.per_sender and c == ARG_HASH)]

    def index_on(self, columns: set[str]) -> Index | None:
        """The longest index whose columns are all among those given."""
        fit = [i for i in self.indexes if set(i.columns) <= columns]
        return max(fit, key=lambda i: (len(i.columns), i.unique), default=None)

    def is_unique(self, columns: set[str]) -> bool:
        return any(i.unique and set(i.columns) <= columns for i in self.indexes)


#: The hidden column by which a caller's part of a per-sender view is found.
ARG_HASH = "_arg_hash"


def sender_hash(caller: bytes) -> bytes:
    return hashlib.sha256(caller).digest()


class Catalog:
    """Tables by name, with the DataFrame that holds each one's rows.

    Changes by SQL stack plan on plan. Every CUT of them the table's net change since its last written state is
    written (in proportion to what changed), or, once that is more than SHARE of the table, its whole state.
    """

    CUT, SHARE = 8, 0.2

    def __init__(self, spark: SparkSession, owner: bytes = b"\0" * 32) -> None:
        self.spark, self.owner = spark, owner
        self.tables: dict[str, Table] = {}
        self.frames: dict[str, DataFrame] = {}
        self._distinct: dict[tuple[str, tuple[str, ...]], int] = {}
        self._next: dict[str, int] = {}  # what sequences give next
        self._stacked: dict[str, tuple[DataFrame, list[DataFrame]]] = {}  # last written state, net changes since

    def add(self, name: str, frame: DataFrame, types: dict[str, Type] | None = None, **more) -> Table:
        columns = {f.name: (types or {}).get(f.name) or of_spark(f.dataType) for f in frame.schema.fields}
        table = Table(name, columns, **more)
        self.tables[name] = table
        self.put(name, frame)
        return table

    def put(self, name: str, frame: DataFrame) -> None:
        """A new state of a table."""
        self.frames[name] = frame
        self._stacked.pop(name, None)
        if name in self.tables:
            self.tables[name].rows = None
        self._distinct = {k: v for k, v in self._distinct.items() if k[0] != name}

    def move(self, name: str, frame: DataFrame, net: DataFrame) -> None:
        """A new state that differs from the one before by a net delta."""
        from tidewater.operators import delta

        base, changes = self._stacked.get(name, (self.frames[name], []))
        changes = [*changes, net]
        if len(changes) >= self.CUT:
            net = written(delta.consolidated(reduce(DataFrame.unionByName, changes)), f"changes-{name}")
            if net.count() > self.SHARE * base.count():
                base, changes = written(frame, f"table-{name}"), []
                frame = base
            else:
                changes, frame = [net], delta.folded(base, net)
        self.put(name, frame)
        self._stacked[name] = base, changes

    def start_sequence(self, name: str) -> None:
        """Before a table's first change: its sequence goes on after the largest number there."""
        if name not in self._next:
            column = self.tables[name].sequence
            top = self.frames[name].agg(F.max(F.col(f"`{column}`"))).first()[0]
            top = wide_int(bytes(top), self.tables[name].columns[column]) if isinstance(top, (bytes, bytearray)) else int(top or 0)
            self._next[name] = max(top, 0) + 1

    def next_number(self, name: str) -> int:
        """Every number once, whatever is inserted or deleted meanwhile; after the type's largest comes 1."""
        self.start_sequence(name)
        table = self.tables[name]
        signed, bits = INTS[table.columns[table.sequence].name]
        number = self._next[name]
        self._next[name] = number % ((1 << (bits - signed)) - 1) + 1
        return number

    def add_view(self, name: str, sql: str | None = None, procedure: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None, **more) -> Table:
        """A view by its query, or by a procedure that is given a function from table names to rows. What the
        procedure reads is noted, and it is run again when one of these tables changes."""
        frame, reads = self.evaluated(sql, procedure, self.frames)
        return self.add(name, frame, view=True, sql=sql, procedure=procedure, reads=frozenset(reads), **more)

    def evaluated(self, sql: str | None, procedure, frames: dict[str, DataFrame]) -> tuple[DataFrame, set[str]]:
        """A view's rows over given states of the tables, and the tables it read."""
        reads: set[str] = set()
        if procedure:

            def read(table: str) -> DataFrame:
                reads.add(table)
                return frames[table]

            return procedure(read), reads
        from tidewater.operators.lower import Lowering
        from tidewater.plans.logical import bind

        query = bind(self, sql)
        reads = {t for f in query.fragments for _, t in f.relations}
        return Lowering(self, states=frames).query(query), reads

    def visible_tables(self) -> list[str]:
        """All public user tables that are not event tables."""
        return [t.name for t in self.tables.values() if t.public and not t.event and not t.view]

    def table(self, name: str, caller: bytes | None = None) -> Table:
        """Private tables are only there for the owner (caller None: the owner)."""
        found = self.tables.get(name)
        if not found or not (found.public or caller is None or caller == self.owner):
            raise AccessProblem(f"no such table: `{name}`. If the table exists, it may be marked private.")
        return found

    def count(self, name: str) -> int:
        table = self.tables[name]
        if table.rows is None:
            table.rows = self.frames[name].count()
        return table.rows

    def distinct(self, name: str, columns: tuple[str, ...]) -> int:
        """Number of distinct keys of an index, exactly."""
        key = name, columns
        if key not in self._distinct:
            unique = self.tables[name].is_unique(set(columns))
            self._distinct[key] = self.count(name) if unique else self.frames[name].select(*columns).distinct().count()
        return self._distinct[key]

    def system_tables(self) -> dict[str, DataFrame]:
        """st_table, st_column, st_index: the catalogue as tables."""
        make = self.spark.createDataFrame
        tables = [(t.name, t.public, t.event, t.view, t.primary_key or "") for t in self.tables.values()]
        columns = [(t.name, i, c, str(k)) for t in self.tables.values() for i, (c, k) in enumerate(t.columns.items())]
        indexes = [(t.name, ",".join(i.columns), i.unique, i.kind) for t in self.tables.values() for i in t.indexes]
        return {
            "st_table": make(tables, "table_name string, is_public boolean, is_event boolean, is_view boolean, primary_key string"),
            "st_column": make(columns, "table_name string, col_pos int, col_name string, col_type string"),
            "st_index": make(indexes, "table_name string, columns string, is_unique boolean, kind string"),
        }
