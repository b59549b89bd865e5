"""Which segments a read has to open, from the catalog alone: as column predicates and, for plans, as plain tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.model import Bound, Kind, as_bytes, prefix_bounds


@dataclass(frozen=True)
class SegmentInfo:
    """A segment's row in the catalog."""

    segment_id: str
    path: str
    item_count: int
    key_count: int
    key_lo: bytes
    key_hi: bytes
    seqno_min: int
    seqno_max: int
    tombstone_count: int
    uncompressed_size: int
    file_size: int
    created_at: int = 0
    block_size: int = 4096
    compression: str = "zstd"
    version: int = 0

    def holds(self, key: bytes | str) -> bool:
        return self.key_lo <= as_bytes(key) <= self.key_hi

    def overlaps(self, low: Bound, high: Bound) -> bool:
        if low.kind != Kind.UNBOUNDED and not (self.key_hi >= low.key if low.kind == Kind.INCLUDED else self.key_hi > low.key):
            return False
        return high.kind == Kind.UNBOUNDED or (self.key_lo <= high.key if high.kind == Kind.INCLUDED else self.key_lo < high.key)

    def seen_by(self, snapshot: int | None) -> bool:
        return snapshot is None or self.seqno_min < snapshot


def chosen(segments: list[SegmentInfo], low: Bound, high: Bound, snapshot: int | None = None) -> list[SegmentInfo]:
    """The segments of a scan. A row of the catalog for each segment is on the driver, as in any file listing."""
    return [s for s in segments if s.overlaps(low, high) and s.seen_by(snapshot)]


def range_overlap(low: Bound, high: Bound) -> Column:
    """Does [key_lo, key_hi] meet the range? Unbounded on both sides: always."""
    test = F.lit(True)
    if low.kind != Kind.UNBOUNDED:
        test = F.col("key_hi") >= F.lit(low.key) if low.kind == Kind.INCLUDED else F.col("key_hi") > F.lit(low.key)
    if high.kind != Kind.UNBOUNDED:
        test = test & (F.col("key_lo") <= F.lit(high.key) if high.kind == Kind.INCLUDED else F.col("key_lo") < F.lit(high.key))
    return test


def for_key(catalog: DataFrame, key: bytes | str, snapshot: int | None = None) -> DataFrame:
    return for_range(catalog, Bound.included(key), Bound.included(key), snapshot)


def for_range(catalog: DataFrame, low: Bound, high: Bound, snapshot: int | None = None) -> DataFrame:
    found = catalog.where(range_overlap(low, high))
    return found if snapshot is None else found.where(F.col("seqno_min") < snapshot)


def for_prefix(catalog: DataFrame, prefix: bytes | str, snapshot: int | None = None) -> DataFrame:
    return for_range(catalog, *prefix_bounds(prefix), snapshot)


def for_snapshot(catalog: DataFrame, snapshot: int) -> DataFrame:
    return catalog.where(F.col("seqno_min") < snapshot)


def overlaps(catalog: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, segment_id): for a small table of inclusive ranges (range_id, lo, hi) the segments that each meets."""
    return catalog.join(ranges, (F.col("key_lo") <= F.col("hi")) & (F.col("key_hi") >= F.col("lo"))).select("range_id", "segment_id")
