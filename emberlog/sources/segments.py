"""Segments: immutable, sorted Parquet folders, each with its statistics."""

from __future__ import annotations

import base64
import json
import math
import os
import shutil
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.model import LOG, Corrupt
from emberlog.operators.statistics import segment_metadata
from emberlog.plans.pruning import SegmentInfo
from emberlog.sources.files import rewrite_atomic, segment_id

#: Spark doesn't read files whose names begin so.
META = "_meta.json"
CATALOG = (
    "segment_id string, path string, item_count long, key_count long, key_lo binary, key_hi binary, seqno_min long, seqno_max long, tombstone_count long,"
    " uncompressed_size long, file_size long, created_at long, block_size int, compression string, version int"
)


def write(rows: DataFrame, folder: str, size: int, segment_bytes: int, block_size: int = 4096, compression: str = "zstd") -> list[SegmentInfo]:
    """Writes a log as segments of about segment_bytes, given its size in bytes, and returns their statistics.

    Rows are dealt by ranges of (key, seqno): segments are disjoint but for the versions of a key at an edge, and a
    key with very many versions takes several. Files come whole into their places by renaming, so what a lost task
    or a stopped driver leaves behind is never read. folder is one that driver and executors share.
    """
    base, n = segment_id(), max(1, math.ceil(size / segment_bytes))
    temporary = f"{folder}/.{base}.tmp"
    dealt = rows.select(*LOG.names)
    dealt = dealt.repartitionByRange(n, F.col("key"), F.desc("seqno")) if n > 1 else dealt.coalesce(1)
    dealt = dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "key", F.desc("seqno"), F.desc("value_type"))
    writer = dealt.write.partitionBy("part").option("compression", compression).option("parquet.page.size", str(block_size))
    writer.option("parquet.bloom.filter.enabled#key", "true").parquet(temporary)
    found = []
    if any(x.startswith("part=") for x in os.listdir(temporary)):
        written = rows.sparkSession.read.parquet(temporary).withColumnRenamed("part", "segment_id")
        for r in sorted(segment_metadata(written).collect(), key=lambda r: r["segment_id"]):
            own = f"{base}-{r['segment_id']:06d}"
            place = f"{folder}/{own}"
            os.rename(f"{temporary}/part={r['segment_id']}", place)
            numbers = {k: r[k] for k in ("item_count", "key_count", "seqno_min", "seqno_max", "tombstone_count", "uncompressed_size")}
            bytes_ = sum(os.path.getsize(f"{place}/{x}") for x in os.listdir(place))
            info = SegmentInfo(own, place, key_lo=bytes(r["key_lo"]), key_hi=bytes(r["key_hi"]), file_size=bytes_, created_at=time.time_ns() // 1000, block_size=block_size, compression=compression, **numbers)
            save(info)
            found.append(info)
    shutil.rmtree(temporary, ignore_errors=True)
    return found


def save(info: SegmentInfo) -> None:
    kept = asdict(info) | {k: base64.b64encode(getattr(info, k)).decode() for k in ("key_lo", "key_hi")}
    kept.pop("path")
    rewrite_atomic(f"{info.path}/{META}", json.dumps(kept).encode())


def load(path: str) -> SegmentInfo:
    try:
        with open(f"{path}/{META}", encoding="utf-8") as file:
            kept = json.load(file)
        return SegmentInfo(path=path, **(kept | {k: base64.b64decode(kept[k]) for k in ("key_lo", "key_hi")}))
    except (OSError, ValueError, KeyError, TypeError) as why:
        raise Corrupt(f"{path} is no segment: {why}") from why


def read(spark: SparkSession, segments: list[SegmentInfo]) -> DataFrame:
    """All versions in the given segments; with an explicit schema no file is opened to plan it."""
    if not segments:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(*(s.path for s in segments))


def catalog(spark: SparkSession, segments: list[SegmentInfo]) -> DataFrame:
    names = [x.split()[0] for x in CATALOG.split(",")]
    return spark.createDataFrame([tuple(getattr(s, k) for k in names) for s in segments], CATALOG)
