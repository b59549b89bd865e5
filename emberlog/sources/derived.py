"""Logs, catalogs and manifests derived from plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def padded(number: str | Column, width: int) -> Column:
    """A number with zeros in front up to that width; longer ones stay whole, so that no two share a key."""
    text = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def log_of(rows: DataFrame, key: Column, value: Column, seqno: Column, deleted: Column | None = None) -> DataFrame:
    """A log from any table: expressions for its columns, and which rows are deletions."""
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    return rows.select(
        key.cast("binary").alias("key"),
        F.when(~gone, F.coalesce(value.cast("string"), F.lit(""))).cast("binary").alias("value"),
        seqno.cast("long").alias("seqno"),
        gone.cast("tinyint").alias("value_type"),
    )


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of users' properties; an error is a deletion."""
    key = F.concat(F.lit("user/"), padded("user_id", 6))
    return log_of(table(spark, folder, "events"), key, F.col("props"), F.col("event_id"), F.col("event_type") == "error")


def orders_log(spark: SparkSession, folder: str) -> DataFrame:
    """Unique keys, grouped by priority."""
    key = F.concat("o_orderpriority", F.lit("/"), padded("o_orderkey", 10))
    return log_of(table(spark, folder, "orders"), key, F.col("o_orderstatus"), F.col("o_orderkey"))


def conversations_log(spark: SparkSession, folder: str) -> DataFrame:
    """A key for each turn; a prefix is a conversation."""
    key = F.concat(padded("conv_id", 8), F.lit("/"), padded("turn", 4))
    return log_of(table(spark, folder, "conversations"), key, F.col("role"), F.col("turn"))


def pages_log(spark: SparkSession, folder: str) -> DataFrame:
    """A key for each URL; a prefix is a site."""
    return log_of(table(spark, folder, "pages").where("url is not null and url <> ''"), F.col("url"), F.col("page_id"), F.col("page_id"))


def in_segments(log: DataFrame, rows: int = 1000) -> DataFrame:
    """A log with segment_id: a segment for each so many sequence numbers."""
    return log.withColumn("segment_id", F.concat(F.lit("seg-"), padded(F.expr(f"seqno div {rows}"), 6)))
