"""The data model: one log of (key, seqno, value_type, value), its order, limits, bounds and prefixes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

RECORD, TOMBSTONE = 0, 1
#: Bytes of a key: one at least, and what an unsigned 16-bit length can say at most.
MIN_KEY, MAX_KEY = 1, 65535
#: Spark holds a binary cell in one Java array.
MAX_VALUE = 2**31 - 16
MAX_SEQNO = 2**63 - 1

LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seqno", T.LongType(), False),
        T.StructField("value_type", T.ByteType(), False),
    ]
)
COLUMNS = tuple(LOG.names)


class EngineError(Exception):
    """Anything that the engine refuses or finds broken."""


class InvalidRecord(EngineError, ValueError):
    """A key, value or sequence number outside the limits."""


class Corrupt(EngineError):
    """Bytes on disk that don't decode: a header, a tag, a trailer, a checksum or text that isn't UTF-8."""


def as_bytes(x: bytes | str | None) -> bytes | None:
    return x.encode() if isinstance(x, str) else None if x is None else bytes(x)


def checked_key(key: bytes | str) -> bytes:
    raw = as_bytes(key)
    if raw is None or not MIN_KEY <= len(raw) <= MAX_KEY:
        raise InvalidRecord(f"a key has {MIN_KEY} to {MAX_KEY} bytes, not {0 if raw is None else len(raw)}")
    return raw


@dataclass(frozen=True)
class Entry:
    """One version of a key."""

    key: bytes
    value: bytes | None
    seqno: int
    value_type: int = RECORD

    def __post_init__(self):
        object.__setattr__(self, "key", checked_key(self.key))
        object.__setattr__(self, "value", as_bytes(self.value))
        object.__setattr__(self, "value_type", RECORD if self.value_type == RECORD else TOMBSTONE)
        if not 0 <= self.seqno <= MAX_SEQNO:
            raise InvalidRecord(f"sequence number {self.seqno} is outside 0..2**63-1")
        if self.value is not None and len(self.value) > MAX_VALUE:
            raise InvalidRecord("a value is too long")
        if self.value is None and self.value_type == RECORD:
            raise InvalidRecord("only a tombstone has no value")

    @classmethod
    def tombstone(cls, key: bytes | str, seqno: int) -> Entry:
        return cls(key, None, seqno, TOMBSTONE)

    @property
    def size(self) -> int:
        return len(self.key) + len(self.value or b"")

    @property
    def is_tombstone(self) -> bool:
        return self.value_type == TOMBSTONE

    @property
    def identity(self) -> tuple[bytes, int, int]:
        return self.key, self.seqno, self.value_type

    @property
    def order(self) -> tuple[bytes, int, int]:
        """Key ascending, then newest first; a tombstone before a record of the same number."""
        return self.key, -self.seqno, -self.value_type

    def row(self) -> tuple:
        return self.key, self.value, self.seqno, self.value_type


class Kind(Enum):
    INCLUDED = "included"
    EXCLUDED = "excluded"
    UNBOUNDED = "unbounded"


@dataclass(frozen=True)
class Bound:
    """One end of a key range."""

    kind: Kind
    key: bytes | None = None

    @classmethod
    def included(cls, key: bytes | str) -> Bound:
        return cls(Kind.INCLUDED, as_bytes(key))

    @classmethod
    def excluded(cls, key: bytes | str) -> Bound:
        return cls(Kind.EXCLUDED, as_bytes(key))

    @classmethod
    def unbounded(cls) -> Bound:
        return cls(Kind.UNBOUNDED)


def after_prefix(prefix: bytes | str) -> bytes | None:
    """The smallest key above all keys with that prefix; None where there is none (empty, or all bytes 0xFF)."""
    rest = as_bytes(prefix).rstrip(b"\xff")
    return rest[:-1] + bytes([rest[-1] + 1]) if rest else None


def prefix_bounds(prefix: bytes | str) -> tuple[Bound, Bound]:
    """A prefix as a range, which Parquet's statistics can use."""
    raw, end = as_bytes(prefix), after_prefix(prefix)
    return (Bound.included(raw) if raw else Bound.unbounded()), (Bound.excluded(end) if end is not None else Bound.unbounded())
