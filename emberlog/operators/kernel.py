"""The versioned merge that every read is made of.

live(log, S) is the newest version of each key among those with seqno < S, without the keys whose newest version is
a tombstone. The three steps stand in this order: a tombstone dropped early would bring an older version back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.records import is_tombstone
from emberlog.model import COLUMNS


def merged(*sources: DataFrame) -> DataFrame:
    """All versions of several logs. Order is no property of a log: reads sort at their edge."""
    return reduce(DataFrame.unionByName, (s.select(*COLUMNS) for s in sources))


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The versions that a snapshot sees: strictly older than its number."""
    return log if snapshot is None else log.where(F.col("seqno") < snapshot)


def newest(log: DataFrame) -> DataFrame:
    """One version for each key: the highest seqno, and of equal ones the tombstone.

    Rank-one windows are cut before the shuffle too, so of a hot key only a row for each task is moved.
    """
    order = Window.partitionBy("key").orderBy(F.desc("seqno"), F.desc("value_type"))
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def newest_by_aggregate(log: DataFrame) -> DataFrame:
    """The same as an aggregate, which streams can keep as state."""
    best = F.max_by(F.struct("value", "seqno", "value_type"), F.struct("seqno", "value_type"))
    return log.groupBy("key").agg(best.alias("_best")).select("key", "_best.value", "_best.seqno", "_best.value_type")


def without_tombstones(log: DataFrame) -> DataFrame:
    return log.where(F.col("value_type") == 0)


def live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return without_tombstones(newest(visible(log, snapshot)))


def masked(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """All versions but those that a newer tombstone of their key hides; tombstones stay.

    Only the newest tombstone matters. It comes from an aggregate that combines before the shuffle, and the join
    that follows can be split where a key is hot; a running window could not.
    """
    seen = visible(log, snapshot)
    last = seen.where(is_tombstone()).groupBy(F.col("key").alias("_key")).agg(F.max("seqno").alias("_dead"))
    both = seen.join(last, seen["key"] == last["_key"], "left")
    stays = F.col("_dead").isNull() | (F.col("seqno") > F.col("_dead")) | ((F.col("seqno") == F.col("_dead")) & is_tombstone())
    return both.where(stays).select(*log.columns)


def in_order(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """Byte order of keys; versions of a key newest first (oldest first in reverse)."""
    columns = [(c, d != reverse) for c, d in (("key", False), ("seqno", True), ("value_type", True)) if c in rows.columns]
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in columns))


def evicted_versions(log: DataFrame, oldest_snapshot: int | None = None, drop_tombstones: bool = False) -> DataFrame:
    """What a compaction keeps: versions from the oldest open snapshot on, and the newest one below it of each key.

    drop_tombstones says that no older version of these keys lives elsewhere, so that one below may go if it is a
    tombstone. Without a snapshot every version is below.
    """
    low = newest(visible(log, oldest_snapshot))
    low = without_tombstones(low) if drop_tombstones else low
    return low if oldest_snapshot is None else low.unionByName(log.where(F.col("seqno") >= oldest_snapshot))
