"""Point reads, scans and counts over a log, at the head or at a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.records import within
from emberlog.model import Bound, as_bytes, prefix_bounds
from emberlog.operators.kernel import in_order, live, visible, without_tombstones


def get(log: DataFrame, key: bytes | str, snapshot: int | None = None) -> DataFrame:
    """(key, value) of a live key, or no row. An empty value is a value."""
    return entry(log, key, snapshot, with_tombstone=False).select("key", "value")


def entry(log: DataFrame, key: bytes | str, snapshot: int | None = None, with_tombstone: bool = True) -> DataFrame:
    """The newest version of a key, which may be a tombstone. A top-1: nothing is shuffled but a row for each task."""
    found = visible(log, snapshot).where(F.col("key") == F.lit(as_bytes(key))).orderBy(F.desc("seqno"), F.desc("value_type")).limit(1)
    return found if with_tombstone else without_tombstones(found)


def contains(log: DataFrame, key: bytes | str, snapshot: int | None = None) -> DataFrame:
    """One row (found)."""
    return get(log, key, snapshot).agg((F.count("*") > 0).alias("found"))


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, value) of the live ones among keys. The semi join goes first, so other keys' versions aren't sorted."""
    wanted = keys.select("key").distinct()
    return live(log.join(wanted, "key", "left_semi"), snapshot).select("key", "value")


def contains_many(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The rows of keys whose key is live."""
    return keys.join(live(log.select("key", "seqno", "value_type"), snapshot).select("key"), "key", "left_semi")


def pairs(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return live(log, snapshot).select("key", "value")


def scan(log: DataFrame, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
    """All live pairs in key order."""
    return in_order(pairs(log, snapshot), reverse)


def between(log: DataFrame, low: Bound, high: Bound, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
    """Live pairs of a key range in order. The comparisons stand below the window and reach the file scan."""
    test = within(low, high)
    return scan(log if test is None else log.where(test), snapshot, reverse)


def key_range(log: DataFrame, start: bytes | str, end: bytes | str, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
    """Both ends belong to the range; start above end gives nothing."""
    return between(log, Bound.included(start), Bound.included(end), snapshot, reverse)


def prefix(log: DataFrame, start: bytes | str, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
    """Live pairs whose key starts so, that key itself included, as a range that files can be pruned by."""
    return between(log, *prefix_bounds(start), snapshot, reverse)


def first(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return scan(log, snapshot).limit(1)


def last(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return scan(log, snapshot, reverse=True).limit(1)


def length(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One row (n): live keys. Values aren't read."""
    return live(log.select("key", "seqno", "value_type"), snapshot).agg(F.count("*").alias("n"))


def is_empty(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One row (empty)."""
    return live(log.select("key", "seqno", "value_type"), snapshot).limit(1).agg((F.count("*") == 0).alias("empty"))
