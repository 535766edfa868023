"""Row lists for clients, wire text, and printed tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import functions as V
from tidewater.plans.types import INTS, Type, is_enum, is_option, wide_int

#: Names of the wire types.
WIRE = {"Bool": "BOOL", "I8": "INT2", "U8": "INT2", "I16": "INT2", "U16": "INT4", "I32": "INT4", "U32": "INT8", "I64": "INT8", "U64": "NUMERIC", "I128": "NUMERIC", "U128": "NUMERIC", "I256": "NUMERIC", "U256": "NUMERIC", "F32": "FLOAT4", "F64": "FLOAT8", "String": "TEXT", "Bytes": "BYTEA", "Identity": "BYTEA", "ConnectionId": "BYTEA", "Timestamp": "TIMESTAMPTZ", "TimeDuration": "INTERVAL", "Uuid": "UUID"}


def wire_type(t: Type) -> str:
    if t.name in WIRE:
        return WIRE[t.name]
    return "ANYENUM" if is_enum(t) else f"{wire_type(t.item)}_ARRAY" if t.item else "JSON"


def _wire(c: Column, t: Type) -> Column:
    if t.name == "Bool":
        return F.when(c, "t").otherwise("f")
    if t.name == "Timestamp":
        return V.rfc3339(c)
    if t.name == "Uuid":
        return V.uuid_text(c)
    if t.name in ("Bytes", "Identity", "ConnectionId") or t.name in INTS and INTS[t.name][1] > 64:
        return V.hex_id(c)
    if t.name in INTS or t.name in ("String", "F32", "F64", "TimeDuration"):
        return c.cast("string")
    return F.to_json(F.struct(c.alias("value")))


def wire_rows(rows: DataFrame, types: dict[str, Type]) -> DataFrame:
    """Every column as the text a wire client gets; the header is wire_type of each."""
    return rows.select(*[_wire(F.col(f"`{c}`"), types[c]).alias(c) for c in rows.columns])


def write_row_lists(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON row lists, compressed (none, gzip, ...); one file a partition."""
    rows.write.option("compression", compression).json(path)


def formatted(value: Any, t: Type, top: bool = True) -> str:
    """A value as printed tables show it."""
    if t.name == "Unit":
        return "()"
    if is_option(t):
        return "(none = ())" if value is None else f"(some = {formatted(value, t.fields[0][1], False)})"
    if t.name == "Sum":
        tag = value["tag"]
        name, inner = t.fields[tag]
        return f"({name} = {formatted(None if inner.name == 'Unit' else value[name], inner, False)})"
    if t.name == "Product":
        return "(" + ", ".join(f"{n} = {formatted(value[n], f, False)}" for n, f in t.fields) + ")"
    if t.name == "Array":
        return "[" + ", ".join(formatted(v, t.item, False) for v in value) + "]"
    if t.name == "Bool":
        return "true" if value else "false"
    if t.name == "String":
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if t.name in ("Bytes", "Identity", "ConnectionId"):
        return "0x" + bytes(value).hex()
    if t.name == "Uuid":
        h = bytes(value).hex()
        return f'"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"'
    if t.name == "Timestamp":
        return value.strftime("%Y-%m-%dT%H:%M:%S") + (f".{value.microsecond:06d}" if value.microsecond else "") + "+00:00"
    if t.name == "TimeDuration":
        n = round(value.total_seconds() * 1_000_000)
        return f"{'-' if n < 0 else '+'}{abs(n) // 1_000_000}.{abs(n) % 1_000_000:06d}"
    if t.name in INTS and INTS[t.name][1] > 64:
        return str(wide_int(value, t))
    return str(value)


def printed(rows: DataFrame, types: dict[str, Type], most: int = 1000) -> str:
    """A table as text; of long results the first ``most`` rows."""
    lines = [list(rows.columns)] + [[formatted(r[c], types[c]) for c in rows.columns] for r in rows.limit(most).collect()]
    widths = [max(len(line[i]) for line in lines) for i in range(len(rows.columns))]
    text = [" " + " | ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in lines]
    return "\n".join([text[0], "-" + "-+-".join("-" * w for w in widths) + "-", *text[1:]])
