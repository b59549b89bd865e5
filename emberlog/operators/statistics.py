"""Counts and sums over logs, segments and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.records import size_of


def segment_metadata(log: DataFrame) -> DataFrame:
    """A row for each segment of a log that has a column segment_id.

    Distinct keys are counted by grouping on (segment, key) first, which combines before the shuffle; the rest is
    summed on top of it, so the log is read and shuffled once.
    """
    by_key = log.groupBy("segment_id", "key").agg(
        F.count("*").alias("n"), F.min("seqno").alias("lo"), F.max("seqno").alias("hi"), F.sum((F.col("value_type") != 0).cast("long")).alias("dead"), F.sum(size_of()).alias("bytes")
    )
    return by_key.groupBy("segment_id").agg(
        F.sum("n").alias("item_count"),
        F.count("*").alias("key_count"),
        F.min("key").alias("key_lo"),
        F.max("key").alias("key_hi"),
        F.min("lo").alias("seqno_min"),
        F.max("hi").alias("seqno_max"),
        F.sum("dead").alias("tombstone_count"),
        F.sum("bytes").alias("uncompressed_size"),
    )


def approximate_length(catalog: DataFrame, buffered: int = 0) -> DataFrame:
    """One row (n): versions and tombstones counted alike, from metadata alone."""
    return catalog.agg((F.coalesce(F.sum("item_count"), F.lit(0)) + F.lit(buffered)).cast("long").alias("n"))


def disk_space(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


def highest_seqno(catalog: DataFrame) -> DataFrame:
    """One row (lsn): the highest number in any segment; 0 without segments."""
    return catalog.agg(F.coalesce(F.max("seqno_max"), F.lit(0)).cast("long").alias("lsn"))


def buffer_statistics(buffer: DataFrame) -> DataFrame:
    """One row (entries, bytes, lsn) of a write buffer."""
    return buffer.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size_of()), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max("seqno"), F.lit(0)).alias("lsn"))


def level_statistics(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """(level, segments, items, bytes) of each level that has a segment."""
    return (
        manifest.join(catalog, "segment_id")
        .groupBy("level")
        .agg(F.count("*").alias("segments"), F.sum("item_count").alias("items"), F.sum("file_size").alias("bytes"))
    )


def usage_order(uses: DataFrame, id_column: str = "id", at_column: str = "at") -> DataFrame:
    """(id, last_used, rank): the least recently used first. Ranks are dense over ids, which are few, not over uses."""
    from pyspark.sql import Window

    seen = uses.groupBy(id_column).agg(F.max(at_column).alias("last_used"))
    return seen.withColumn("rank", F.row_number().over(Window.orderBy("last_used", id_column)))
