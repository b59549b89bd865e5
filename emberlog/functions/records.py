"""Column expressions over records: types, sizes, encodings, checksums, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.model import Bound, Kind


def value_type_of(byte: Column) -> Column:
    """Zero is a record, any other byte a tombstone."""
    return F.when(byte == 0, F.lit(0)).otherwise(F.lit(1)).cast("tinyint")


def is_tombstone(value_type: Column | None = None) -> Column:
    return (F.col("value_type") if value_type is None else value_type) != 0


def size_of(key: str | Column = "key", value: str | Column = "value") -> Column:
    """Bytes of key and value."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def within(low: Bound, high: Bound, key: str | Column = "key") -> Column | None:
    """The comparisons that a key range stands for; None without any."""
    key = F.col(key) if isinstance(key, str) else key
    parts = []
    if low.kind != Kind.UNBOUNDED:
        parts.append(key >= F.lit(low.key) if low.kind == Kind.INCLUDED else key > F.lit(low.key))
    if high.kind != Kind.UNBOUNDED:
        parts.append(key <= F.lit(high.key) if high.kind == Kind.INCLUDED else key < F.lit(high.key))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def _big_endian(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number), digits, "0")


def encoded_hex(key: str = "key", value: str = "value", seqno: str = "seqno", value_type: str = "value_type") -> Column:
    """A record's bytes in hexadecimal: length and key, length and value, sequence number, type; big-endian."""
    raw = F.coalesce(F.col(value), F.lit(b""))
    return F.concat(
        _big_endian(F.octet_length(key), 8), F.hex(key), _big_endian(F.octet_length(raw), 8), F.hex(raw), _big_endian(F.col(seqno), 16), _big_endian(F.col(value_type).cast("int"), 2)
    )


def base36(number: Column) -> Column:
    """A non-negative number in lower-case base 36, as ids of segments are written."""
    return F.lower(F.conv(number.cast("string"), 10, 36))
