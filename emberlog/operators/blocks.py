"""Logical blocks of segments: the layout, checksums, and look-ups in the sparse index of start keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.records import encoded_hex, size_of
from emberlog.model import after_prefix

BLOCK_SIZE = 4096
#: Slices that a segment's probes are dealt into.
SALTS = 8
#: Keys in order that are looked up together, and the parts that the index of all segments is dealt into for them.
RUN, PARTS = 512, 8


def layout(log: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The rows of a log with segment_id, each with its block_no.

    A block ends with the record that brings it to block_size bytes or more; then the count starts again. That rule
    is sequential, so sorted rows stream through one pass that holds a batch and two numbers, never a segment.
    """
    kinds = dict(log.dtypes)
    schema = "segment_id " + kinds["segment_id"] + ", key binary, value binary, seqno long, value_type tinyint, block_no int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, filled = None, 0, 0
        for batch in batches:
            sizes = np.asarray(pc.add(pc.binary_length(batch.column("key")), pc.fill_null(pc.binary_length(batch.column("value")), 0)), np.int64)
            segments, numbers = batch.column("segment_id").to_pylist(), np.zeros(len(sizes), np.int32)
            for i, (segment, size) in enumerate(zip(segments, sizes.tolist())):
                if segment != now:
                    now, block, filled = segment, 0, 0
                numbers[i] = block
                filled += size
                if filled >= block_size:
                    block, filled = block + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "block_no"])

    rows = log.select("segment_id", "key", "value", "seqno", "value_type")
    dealt = rows.repartition("segment_id").sortWithinPartitions("segment_id", "key", F.desc("seqno"), F.desc("value_type"))
    return dealt.mapInArrow(run, schema)


def index(rows: DataFrame) -> DataFrame:
    """(segment_id, block_no, start_key, items, bytes) of laid-out rows: the sparse index."""
    return rows.groupBy("segment_id", "block_no").agg(F.min("key").alias("start_key"), F.count("*").alias("items"), F.sum(size_of()).alias("bytes"))


def checksums(rows: DataFrame) -> DataFrame:
    """(segment_id, block_no, crc): CRC-32 of each block's count and records. A group is one block, so it is small."""
    item = F.struct("key", (-F.col("seqno")).alias("s"), (-F.col("value_type")).alias("t"), encoded_hex().alias("raw"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["raw"]), "")
    blocks = rows.groupBy("segment_id", "block_no").agg(F.count("*").alias("n"), content.alias("raw"))
    return blocks.select("segment_id", "block_no", F.crc32(F.unhex(F.concat(F.lpad(F.hex("n"), 8, "0"), F.col("raw")))).alias("crc"))


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Blocks whose checksum isn't the expected one, or that only one side has."""
    both = found.withColumnRenamed("crc", "got").join(expected.withColumnRenamed("crc", "want"), ["segment_id", "block_no"], "full")
    return both.where(~F.col("got").eqNullSafe(F.col("want")))


def neighbours(blocks: DataFrame) -> DataFrame:
    """Each block with previous_key and next_key, the start keys beside it in its segment."""
    order = Window.partitionBy("segment_id").orderBy("start_key", "block_no")
    return blocks.withColumn("previous_key", F.lag("start_key").over(order)).withColumn("next_key", F.lead("start_key").over(order))


def ends(blocks: DataFrame) -> DataFrame:
    """(segment_id, first_block, last_block)."""
    at = F.struct("start_key", "block_no")
    return blocks.groupBy("segment_id").agg(F.min_by("block_no", at).alias("first_block"), F.max_by("block_no", at).alias("last_block"))


def lower_bound(blocks: DataFrame, probes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(segment_id, key, block_no): for each probe the last block with start_key <= key, null below the first one.

    An as-of join: index rows and probes go through one sorted window for each segment, without a range join. Probes
    of a segment are dealt into slices, each with a copy of that segment's index, so a hot segment is many tasks.
    """
    return _asof(blocks, probes, salts, ahead=False)


def upper_bound(blocks: DataFrame, probes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(segment_id, key, block_no): for each probe the first block with start_key > key, null above the last one."""
    return _asof(blocks, probes, salts, ahead=True)


def _asof(blocks: DataFrame, probes: DataFrame, salts: int, ahead: bool) -> DataFrame:
    slices = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    index_rows = blocks.select("segment_id", F.col("start_key").alias("key"), "block_no", F.lit(0).alias("probe"), slices.alias("slice"))
    asked = probes.select(
        "segment_id", "key", F.lit(None).cast("int").alias("block_no"), F.lit(1).alias("probe"), F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("slice")
    )
    # Of equal keys, a probe sees its own block behind it and never ahead: descending, the probe comes first.
    order = [F.desc(c) if ahead else F.asc(c) for c in ("key", "probe", "block_no")]
    before = Window.partitionBy("segment_id", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last("block_no", ignorenulls=True).over(before)
    return index_rows.unionByName(asked).withColumn("found", found).where("probe = 1").select("segment_id", "key", F.col("found").alias("block_no"))


def lower_bound_everywhere(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """(segment_id, key, block_no): lower_bound of each key in each segment, without a row of it in a shuffle.

    Null keys and segments without start keys get null; a null segment_id equals none and is left out.
    """
    return _everywhere(blocks, keys, ahead=False)


def upper_bound_everywhere(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """(segment_id, key, block_no): upper_bound of each key in each segment, as lower_bound_everywhere."""
    return _everywhere(blocks, keys, ahead=True)


def _everywhere(blocks: DataFrame, keys: DataFrame, ahead: bool) -> DataFrame:
    """Only spans between start keys and runs of sorted keys are shuffled. Pairs that overlap give their keys in place.

    Most spans take a run whole; those that begin or end in it take a part. Both sides end in an exchange, so that a
    pair of their parts is one task, which reads them and computes neither again. No part is held by a broadcast.
    """
    session = blocks.sparkSession
    runs = _runs(keys).repartition(int(session.conf.get("spark.sql.shuffle.partitions")))
    none = F.array(F.lit(None))
    at = F.array_sort(F.collect_list(F.when(F.col("start_key").isNotNull(), F.struct("start_key", "block_no"))))
    starts = blocks.where("segment_id is not null").groupBy("segment_id").agg(at.alias("at"))
    spans = starts.select(
        "segment_id",
        F.concat(none, F.col("at.start_key")).alias("low"),
        F.concat(F.col("at.start_key"), none).alias("high"),
        (F.concat(F.col("at.block_no"), none) if ahead else F.concat(none, F.col("at.block_no"))).alias("block_no"),
    )
    spans = spans.select("segment_id", F.inline(F.arrays_zip("low", "high", "block_no"))).where("low is null or high is null or low < high").repartition(PARTS)
    # Null keys are a run without bounds: of a segment they take the one span outside of its blocks.
    meets = F.when(F.col("least").isNull(), F.col("block_no").isNull()).otherwise(F.expr("(low is null or low <= most) and (high is null or high > least)"))
    pairs = runs.hint("shuffle_replicate_nl").join(spans, meets)
    # Bounds are kept where they fall into the run. Whole runs are given without a comparison, and all in generated code.
    inner = [F.when(F.col("low") > F.col("least"), F.col("low")).alias("low"), F.when(F.col("high") <= F.col("most"), F.col("high")).alias("high")]
    found = pairs.select("segment_id", "keys", "block_no", *inner).select("segment_id", F.explode("keys").alias("key"), "block_no", "low", "high")
    return found.where("(low is null or key >= low) and (high is null or key < high)").select("segment_id", "key", "block_no")


def _runs(keys: DataFrame) -> DataFrame:
    """(keys, least, most): sorted keys in arrays of RUN at most. Null keys are in arrays of their own, without bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("key")
            for own in (column.filter(column.is_null()), column.drop_null()):
                ends = pa.array([*range(0, len(own), RUN), len(own)], pa.int32())
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, own)], names=["keys"])

    dealt = keys.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, f"keys array<{dict(keys.dtypes)['key']}>")
    return dealt.select("keys", F.element_at("keys", 1).alias("least"), F.element_at("keys", -1).alias("most"))


def prefix_upper_bound(blocks: DataFrame, prefix: bytes | str) -> DataFrame:
    """(segment_id, block_no): in each segment the first block that starts past all keys with the prefix."""
    end = after_prefix(prefix)
    past = blocks.where(F.lit(False) if end is None else F.col("start_key") >= F.lit(end))
    return past.groupBy("segment_id").agg(F.min_by("block_no", F.struct("start_key", "block_no")).alias("block_no"))
