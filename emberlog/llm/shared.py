"""What the corpus operators share: the shared folder, tables cut from their lineage, text buffers, hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step holds; its numpy temporaries are about forty times that.
STEP_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table, so that no other is read and none can clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(df[f"`{c}`"] for c in columns)) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in tests on one machine, a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages survive the loss of any executor."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder given as a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of at most so many bytes of text (one row at least), with their texts; null reads as ''."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        part = batch.slice(at, to - at)
        yield part, [x or "" for x in part.column(column).to_pylist()]
        at = to


def release() -> None:
    """Hands freed memory back to the system. Workers live on between stages, and beside them a later stage needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that releases memory when the task ends."""

    @functools.wraps(run)
    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def joined(texts: list[str], lower: bool = False, gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with a gap byte before, between and after them, and where each text's gap is."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(gap + gap.join(raw) + gap, np.uint8)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    if lower:
        data = LOWER[data]
    return data, starts


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end] for many spans at once.

    Values are spread over 64 bits first; equal spans have equal hashes wherever they stand.
    """
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    spread = (values.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0x9E6D62D06F6A9A9B)
    spread ^= spread >> np.uint64(29)
    spread *= up[:-1]
    np.cumsum(spread, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])
