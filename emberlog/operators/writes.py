"""What a batch of writes goes through before it is stored: validation, sequence numbers, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.model import COLUMNS, MAX_KEY, MIN_KEY


def validated(log: DataFrame) -> DataFrame:
    """The same rows; the job that uses them fails at the first key outside the limits or record without a value."""
    size = F.octet_length("key")
    bad = F.coalesce((size < MIN_KEY) | (size > MAX_KEY), F.lit(True))
    key = F.when(bad, F.raise_error(F.lit(f"a key has {MIN_KEY} to {MAX_KEY} bytes"))).otherwise(F.col("key"))
    lost = (F.col("value_type") == 0) & F.col("value").isNull()
    value = F.when(lost, F.raise_error(F.lit("only a tombstone has no value"))).otherwise(F.col("value"))
    return log.withColumn("key", key.cast("binary")).withColumn("value", value.cast("binary"))


def invalid(log: DataFrame) -> DataFrame:
    """The rows that validated() would refuse."""
    size = F.octet_length("key")
    return log.where(F.coalesce((size < MIN_KEY) | (size > MAX_KEY), F.lit(True)) | ((F.col("value_type") == 0) & F.col("value").isNull()))


def numbered(batch: DataFrame, ordinal: str, first: int, rows: int = 1 << 20, width: int | None = None, shared: bool = True) -> DataFrame:
    """batch with a dense column seqno from first on, in ascending order of ordinal, an integer column; nulls come last.

    Ordinals are dealt into ranges of a width. Where none is given, it is the one whose ranges hold about so many rows each,
    so that sparse ordinals, as times or hashes are, make no more ranges than dense ones. Ranks within a range and running counts over ranges give the number,
    so no task sorts more than a range's rows and one gathers a number for each range. Rows that share an ordinal, or have
    none, share a sequence number: they are one batch, which becomes visible at once. With shared=False each row has its own.
    """
    if width is None:
        low, high, n = batch.agg(F.min(ordinal), F.max(ordinal), F.count("*")).first()
        width = -(-(high - low + 1) // -(-n // rows)) if n and low is not None else 1
    else:
        low = 0
    place = F.floor((F.col(ordinal) - F.lit(low or 0)) / width)
    dealt = batch.withColumn("_range", F.coalesce(place, F.lit((1 << 63) - 1)))  # a join finds no nulls
    counts = dealt.groupBy("_range").agg((F.count_distinct(ordinal) if shared else F.count("*")).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = (F.dense_rank() if shared else F.row_number()).over(Window.partitionBy("_range").orderBy(F.col(ordinal).asc_nulls_last()))
    out = dealt.join(before, "_range").withColumn("seqno", (F.lit(first - 1) + F.col("_before") + rank).cast("long"))
    return out.select(*batch.columns, "seqno")


def batch(rows: DataFrame, seqno: int) -> DataFrame:
    """Rows (key, value, value_type) that become visible together, under one sequence number."""
    return rows.select("key", "value", F.lit(seqno).cast("long").alias("seqno"), "value_type")


def upserted(log: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each (key, seqno, value_type): the last by order where given."""
    if order is None:
        return log.dropDuplicates(["key", "seqno", "value_type"])
    best = F.max_by("value", order).alias("value")
    return log.groupBy("key", "seqno", "value_type").agg(best).select(*COLUMNS)
