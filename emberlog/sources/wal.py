"""The write-ahead log: one JSON line for each entry, replayed up to the first line that isn't one."""

from __future__ import annotations

import base64
import json
import os
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.records import value_type_of
from emberlog.model import Entry, InvalidRecord
from emberlog.sources.files import sync_folder

#: Seconds between syncs.
SYNC_SECONDS = 1.0
SCHEMA = "k string, v string, s long, t tinyint"
#: A key or value that isn't UTF-8 text stands in base 64 behind this sign, and text that begins with it does too.
ESCAPE = "\x00b64:"


def _text(raw: bytes | None) -> str:
    try:
        text = (raw or b"").decode("utf-8")
    except UnicodeDecodeError:
        text = ESCAPE
    return ESCAPE + base64.b64encode(raw).decode() if text.startswith(ESCAPE) else text


def _raw(text: str) -> bytes:
    return base64.b64decode(text.removeprefix(ESCAPE), validate=True) if text.startswith(ESCAPE) else text.encode("utf-8")


def line_of(entry: Entry) -> str:
    return json.dumps({"k": _text(entry.key), "v": _text(entry.value), "s": entry.seqno, "t": entry.value_type}, ensure_ascii=False)


def entry_of(line: str) -> Entry | None:
    """The entry of a line; None for a blank or malformed one."""
    try:
        x = json.loads(line)
        if not (isinstance(x, dict) and isinstance(x["k"], str) and isinstance(x["v"], str) and type(x["s"]) is int and type(x["t"]) is int):
            return None
        return Entry(_raw(x["k"]), None if x["t"] else _raw(x["v"]), x["s"], x["t"])
    except (ValueError, KeyError, InvalidRecord):
        return None


class Wal:
    """Append, sync, truncate and replay. It holds a write buffer's entries at most, so the driver reads it.

    What was appended is on the disk after SYNC_SECONDS at most: a thread syncs the file when there is anything new.
    """

    def __init__(self, path: str, seconds: float = SYNC_SECONDS):
        self.path = path
        entries, good = self.replay(path)
        self.recovered = entries
        if os.path.exists(path) and good < os.path.getsize(path):
            os.truncate(path, good)  # what stands behind the first bad line would come back after the next append
        self._file = open(path, "ab")
        self._lock, self._new, self._closed = threading.Lock(), False, threading.Event()
        self._syncs = threading.Thread(target=self._sync_often, args=(seconds,), daemon=True)
        self._syncs.start()

    def _sync_often(self, seconds: float) -> None:
        while not self._closed.wait(seconds):
            if self._new:
                self.sync()

    @staticmethod
    def replay(path: str) -> tuple[list[Entry], int]:
        """(entries before the first bad line, bytes that they take)."""
        entries, good = [], 0
        if os.path.exists(path):
            with open(path, "rb") as file:
                for raw in file:
                    try:
                        entry = entry_of(raw.decode("utf-8")) if raw.endswith(b"\n") else None
                    except UnicodeDecodeError:
                        entry = None
                    if entry is None:
                        break
                    entries.append(entry)
                    good += len(raw)
        return entries, good

    def append(self, entries: Iterable[Entry]) -> None:
        with self._lock:
            self._file.write("".join(line_of(e) + "\n" for e in entries).encode("utf-8"))
            self._file.flush()
            self._new = True

    @property
    def is_synced(self) -> bool:
        return not self._new

    def sync(self) -> None:
        with self._lock:
            self._sync()

    def _sync(self) -> None:
        if not self._file.closed:
            self._file.flush()
            os.fsync(self._file.fileno())
            self._new = False

    def truncate(self) -> None:
        with self._lock:
            self._file.truncate(0)
            self._file.seek(0)
            self._sync()
        sync_folder(os.path.dirname(self.path) or ".")

    def close(self) -> None:
        self._closed.set()
        with self._lock:
            self._file.close()
        self._syncs.join()


def import_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines logs of any size as a log DataFrame: files in order of name, up to the first malformed line.

    Lines have their file, block and number as a position. The least position of a bad line is one row, and no line
    is moved.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"))
    parsed = lines.withColumn("x", F.from_json("value", SCHEMA))
    fine = F.col("x.k").isNotNull() & F.col("x.v").isNotNull() & F.col("x.s").isNotNull() & F.col("x.t").isNotNull() & (F.octet_length("x.k") > 0)
    cut = parsed.where(~F.coalesce(fine, F.lit(False))).agg(F.min("at").alias("_cut"))
    kept = parsed.crossJoin(F.broadcast(cut)).where("_cut is null or at < _cut")  # one row
    raw = lambda c: F.when(F.col(c).startswith(ESCAPE), F.unbase64(F.substr(c, F.lit(len(ESCAPE) + 1)))).otherwise(F.col(c).cast("binary"))
    kind = value_type_of(F.col("x.t"))
    return kept.select(raw("x.k").alias("key"), F.when(kind == 0, raw("x.v")).alias("value"), F.col("x.s").alias("seqno"), kind.alias("value_type"))
