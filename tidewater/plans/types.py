"""The type system, its Spark storage, and literals.

Every value has exactly one type; nothing is ever null or cast. 128- and 256-bit integers do not fit a
Spark decimal, so they are stored as big-endian bytes (with the sign bit flipped for signed ones), which
compare like the numbers.
"""

from __future__ import annotations

import re
import struct
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import types as T

from tidewater.errors import BindProblem


@dataclass(frozen=True)
class Type:
    """name: Bool, I8 .. U256, F32, F64, String, Bytes, Identity, ConnectionId, Timestamp, TimeDuration, Uuid,
    Array (of item), Product (of fields), Sum (of fields), Unit."""

    name: str
    item: Type | None = None
    fields: tuple[tuple[str, Type], ...] = field(default=())

    def __str__(self) -> str:
        if self.item:
            return f"{self.name}<{self.item}>"
        return f"{self.name}({', '.join(f'{n}: {t}' for n, t in self.fields)})" if self.fields else self.name


BOOL, STRING, BYTES = Type("Bool"), Type("String"), Type("Bytes")
I8, I16, I32, I64, I128, I256 = (Type(f"I{n}") for n in (8, 16, 32, 64, 128, 256))
U8, U16, U32, U64, U128, U256 = (Type(f"U{n}") for n in (8, 16, 32, 64, 128, 256))
F32, F64 = Type("F32"), Type("F64")
IDENTITY, CONNECTION, UUID = Type("Identity"), Type("ConnectionId"), Type("Uuid")
TIMESTAMP, DURATION, UNIT = Type("Timestamp"), Type("TimeDuration"), Type("Unit")
INTS = {t.name: (t.name[0] == "I", int(t.name[1:])) for t in (I8, I16, I32, I64, I128, I256, U8, U16, U32, U64, U128, U256)}


def array(item: Type) -> Type:
    return BYTES if item == U8 else Type("Array", item)


def product(**fields: Type) -> Type:
    return Type("Product", None, tuple(fields.items()))


def sum_of(**variants: Type) -> Type:
    return Type("Sum", None, tuple(variants.items()))


def option(item: Type) -> Type:
    return sum_of(some=item, none=UNIT)


def result(ok: Type, err: Type) -> Type:
    return sum_of(ok=ok, err=err)


def is_option(t: Type) -> bool:
    return t.name == "Sum" and len(t.fields) == 2 and t.fields[0][0] == "some" and t.fields[1] == ("none", UNIT)


def is_enum(t: Type) -> bool:
    return t.name == "Sum" and bool(t.fields) and all(v == UNIT for _, v in t.fields)


def comparable(t: Type) -> bool:
    """May stand in a comparison."""
    return t.name in INTS or t.name in ("Bool", "F32", "F64", "String", "Bytes", "Identity", "ConnectionId", "Timestamp", "Uuid")


_STORED = {
    "Bool": T.BooleanType(), "I8": T.ByteType(), "I16": T.ShortType(), "I32": T.IntegerType(), "I64": T.LongType(),
    "U8": T.ShortType(), "U16": T.IntegerType(), "U32": T.LongType(), "U64": T.DecimalType(20, 0), "F32": T.FloatType(), "F64": T.DoubleType(),
    "I128": T.BinaryType(), "U128": T.BinaryType(), "I256": T.BinaryType(), "U256": T.BinaryType(), "String": T.StringType(), "Bytes": T.BinaryType(),
    "Identity": T.BinaryType(), "ConnectionId": T.BinaryType(), "Uuid": T.BinaryType(), "Timestamp": T.TimestampType(), "TimeDuration": T.DayTimeIntervalType(), "Unit": T.StructType([]),
}


def stored(t: Type) -> T.DataType:
    """The Spark type a column of type t has. A sum is its tag and one nullable field for each variant with data."""
    if t.name in _STORED:
        return _STORED[t.name]
    if t.name == "Array" and t.item:
        return T.ArrayType(stored(t.item), containsNull=False)
    if t.name == "Product":
        return T.StructType([T.StructField(n, stored(f), False) for n, f in t.fields])
    if t.name == "Sum":
        if is_option(t):
            return stored(t.fields[0][1])
        return T.StructType([T.StructField("tag", T.ByteType(), False)] + [T.StructField(n, stored(f), True) for n, f in t.fields if f != UNIT])
    raise BindProblem(f"no storage for {t}")


def of_spark(t: T.DataType) -> Type:
    """The type that a Spark column is taken to have when a table is registered without types."""
    simple = {T.BooleanType: BOOL, T.ByteType: I8, T.ShortType: I16, T.IntegerType: I32, T.LongType: I64, T.FloatType: F32, T.DoubleType: F64, T.StringType: STRING, T.BinaryType: BYTES, T.TimestampType: TIMESTAMP, T.TimestampNTZType: TIMESTAMP, T.DayTimeIntervalType: DURATION}
    if type(t) in simple:
        return simple[type(t)]
    if isinstance(t, T.DecimalType) and t.scale == 0 and t.precision <= 20:
        return U64
    if isinstance(t, T.ArrayType):
        return array(of_spark(t.elementType))
    if isinstance(t, T.StructType):
        return Type("Product", None, tuple((f.name, of_spark(f.dataType)) for f in t.fields))
    raise BindProblem(f"no type for {t.simpleString()}")


def wide_bytes(value: int, t: Type) -> bytes:
    """Stored form of a 128- or 256-bit integer."""
    signed, bits = INTS[t.name]
    return (value + (1 << (bits - 1)) if signed else value).to_bytes(bits // 8, "big")


def wide_int(stored_bytes: bytes, t: Type) -> int:
    signed, bits = INTS[t.name]
    return int.from_bytes(stored_bytes, "big") - ((1 << (bits - 1)) if signed else 0)


def _number(text: str) -> Decimal:
    try:
        return Decimal(text)
    except InvalidOperation:
        raise BindProblem(f"{text} is not a number") from None


def _hex(text: str, size: int | None = None) -> bytes:
    digits = text[2:] if text[:2] in ("0x", "0X") else text
    if size is None and len(digits) % 2:
        digits = "0" + digits
    if not re.fullmatch("[0-9a-fA-F]*", digits) or (size is not None and len(digits) != 2 * size):
        raise BindProblem(f"{text} is not a hex value" + (f" of {size} bytes" if size else ""))
    return bytes.fromhex(digits)


_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")


def parse_time(text: str) -> datetime:
    """RFC 3339 with T or a blank; digits past the microsecond are cut."""
    m = _TIME.fullmatch(text)
    if not m:
        raise BindProblem(f"{text!r} is not a timestamp")
    *whole, part, zone = m.groups()
    shift = timedelta(0) if zone in "Zz" else timedelta(hours=int(zone[1:3]), minutes=int(zone[4:])) * (-1 if zone[0] == "-" else 1)
    try:
        at = datetime(*map(int, whole), microsecond=int((part or ".0")[1:7].ljust(6, "0")), tzinfo=timezone.utc)
    except ValueError as e:
        raise BindProblem(f"{text!r} is not a timestamp: {e}") from None
    return at - shift


def literal(text: str, t: Type) -> Any:
    """The value in type t (as Spark stores it) that a literal stands for. The text of a hex literal starts with 0x."""
    if t.name in INTS:
        signed, bits = INTS[t.name]
        number = _number(text)
        if number.is_nan() or number.is_infinite() or number != number.to_integral_value():
            raise BindProblem(f"{text} is not an integer")
        value = int(number)
        low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
        if not low <= value <= high:
            raise BindProblem(f"{text} is out of bounds for type {t}")
        return wide_bytes(value, t) if bits > 64 else Decimal(value) if t == U64 else value
    if t == F64:
        return float(_number(text))
    if t == F32:
        try:
            return struct.unpack("<f", struct.pack("<f", float(_number(text))))[0]
        except OverflowError:  # past the largest, as IEEE rounds it
            return float("-inf") if text.lstrip().startswith("-") else float("inf")
    if t == STRING:
        return text
    if t == BYTES:
        return _hex(text)
    if t == IDENTITY:
        return _hex(text, 32)
    if t == CONNECTION:
        return _hex(text, 16)
    if t == UUID:
        try:
            return uuid.UUID(text).bytes
        except ValueError:
            raise BindProblem(f"{text!r} is not a UUID") from None
    if t == TIMESTAMP:
        return parse_time(text)
    raise BindProblem(f"there are no literals of type {t}")
