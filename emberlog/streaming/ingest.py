"""Streams into a store, and the newest version of each key as a stream's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.kernel import newest_by_aggregate, without_tombstones
from emberlog.store import Store


def ingest(rows: DataFrame, store: Store, ordinal: str, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that stores each micro-batch of rows (key, value, value_type, ordinal) as segments, once.

    Numbers follow the order of micro-batches, and within each the column ordinal.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        store.ingest(batch, ordinal, name, epoch)

    writer = rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(log: DataFrame) -> DataFrame:
    """Live pairs of a streaming log. Its state holds one version a key; late versions are no problem, since the
    highest number wins whenever it comes. For output mode complete or, with tombstones in sight, update."""
    return without_tombstones(newest_by_aggregate(log)).select("key", "value")


def changes(log: DataFrame) -> DataFrame:
    """The newest version of each key that changed, tombstones included: for output mode update."""
    return newest_by_aggregate(log)
