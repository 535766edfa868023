"""Scalar helpers as Spark columns: times, sequences, schedules, UUIDs, hex. No Python runs per row."""

from __future__ import annotations

import hashlib
import os
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(at: Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(at.cast("timestamp"))


def add_micros(at: Column, n: Column) -> Column:
    return F.timestamp_micros(micros(at) + n)


def micros_between(later: Column, earlier: Column) -> Column:
    return micros(later) - micros(earlier)


def rfc3339(at: Column) -> Column:
    """UTC text with microseconds where there are any."""
    whole = F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros(at), F.lit(1_000_000))
    return F.concat(whole, F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def parse_rfc3339(text: Column) -> Column:
    """Null for text that is no timestamp."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"))


def duration_text(n: Column) -> Column:
    """Seconds with sign and six digits."""
    a = F.abs(n)
    return F.concat(F.when(n < 0, "-").otherwise("+"), F.floor(a / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(a, F.lit(1_000_000)).cast("string"), 6, "0"))


def iso_duration(n: Column) -> Column:
    """ISO 8601: PT...S."""
    a = F.abs(n)
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lit("PT"), F.floor(a / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(a, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("S"))


def next_tick(last: Column, interval: Column, now: Column) -> Column:
    """In microseconds: the first tick after now of a schedule anchored at last; ticks that were missed are
    skipped, one that is still ahead is the next. An interval of 0 gives last."""
    step = F.abs(interval)
    ticks = F.when(now <= last, F.lit(1).cast("long")).otherwise(F.floor(F.try_divide((now - last).cast("decimal(20,0)"), step)).cast("long") + 1)
    return F.when(step == 0, last).otherwise(last + step * ticks)


def next_in_sequence(value: Column, increment: int, low: int, high: int) -> Column:
    """The number after value; past an end it goes on from the other."""
    after, size = value + F.lit(increment), high - low + 1
    return F.when((after > high) | (after < low), F.lit(low) + F.pmod(after - low, F.lit(size))).otherwise(after)


def hex_id(b: Column) -> Column:
    """An identity or connection id as text."""
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def unhex_id(text: Column) -> Column:
    return F.unhex(F.regexp_replace(text, "^0[xX]", ""))


def uuid_text(b: Column) -> Column:
    h = F.lower(F.hex(b))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def uuid_bytes(text: Column) -> Column:
    """Null for text that is no UUID."""
    plain = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    return F.when(F.regexp_like(plain, F.lit("^[0-9a-f]{32}$")), F.unhex(plain))


def uuid_version(b: Column) -> Column:
    return F.conv(F.substring(F.hex(b), 13, 1), 16, 10).cast("int")


def uuid7(counter: int = 0, at_ms: int | None = None) -> uuid.UUID:
    """Version 7: milliseconds, a counter that orders ids of one millisecond, random bits."""
    ms = int(time.time() * 1000) if at_ms is None else at_ms
    value = (ms & (1 << 48) - 1) << 80 | 7 << 76 | (counter & 0xFFF) << 64 | 2 << 62 | int.from_bytes(os.urandom(8), "big") >> 2
    return uuid.UUID(int=value)


def query_hash(sql: str, caller: bytes | None = None) -> str:
    """One subscription plan serves all callers of equal text, or each caller where the text names :sender."""
    return hashlib.sha256(sql.encode() + (caller or b"" if ":sender" in sql else b"")).hexdigest()
