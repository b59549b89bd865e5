"""Small files that the driver keeps beside the segments: marker, configuration, atomic rewrites, segment ids."""

from __future__ import annotations

import json
import os
import struct
import threading
import time
from dataclasses import dataclass

from emberlog.model import Corrupt

MARKER, CONFIG, MANIFEST, SEGMENTS, WAL = ".lsm", "config.json", "levels.json", "segments", ".wal.jsonl"
MAGIC, VERSION = b"LSM", 0


def rewrite_atomic(path: str, content: bytes) -> None:
    """The whole new content or the whole old one, whenever the process stops."""
    temporary = f"{path}.tmp"
    with open(temporary, "wb") as file:
        file.write(content)
        file.flush()
        os.fsync(file.fileno())
    os.replace(temporary, path)
    sync_folder(os.path.dirname(path) or ".")


def sync_folder(path: str) -> None:
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def header(version: int = VERSION) -> bytes:
    return MAGIC + struct.pack(">H", version)


def parsed_header(raw: bytes) -> int:
    """The version that a header names. Anything else than a known one is refused."""
    if len(raw) < 5 or raw[:3] != MAGIC:
        raise Corrupt("no header of a store")
    (version,) = struct.unpack(">H", raw[3:5])
    if version != VERSION:
        raise Corrupt(f"version {version} isn't known")
    return version


@dataclass(frozen=True)
class Config:
    path: str
    block_size: int = 4096
    level_count: int = 7
    level_ratio: int = 8
    tree_type: int = 0
    #: Bytes of the write buffer that are flushed, and of a segment that compaction aims at.
    buffer_bytes: int = 8 << 20
    segment_bytes: int = 256 << 20
    #: First-level segments above which a write compacts.
    first_level_most: int = 16

    def __post_init__(self):
        for name, least in (("block_size", 1024), ("level_count", 1), ("level_ratio", 2)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} is {least} at least")

    def save(self, path: str) -> None:
        kept = {"path": self.path, "block_size": self.block_size, "level_count": self.level_count, "level_ratio": self.level_ratio, "type": self.tree_type}
        rewrite_atomic(path, json.dumps(kept).encode())

    @classmethod
    def load(cls, path: str, **others) -> Config:
        try:
            with open(path, encoding="utf-8") as file:
                kept = json.load(file)
            return cls(kept["path"], kept["block_size"], kept["level_count"], kept["level_ratio"], kept["type"], **others)
        except (ValueError, KeyError, TypeError) as why:
            raise Corrupt(f"{path} is no configuration: {why}") from why


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_lock, _last = threading.Lock(), [0]


def base36(number: int) -> str:
    out = ""
    while number or not out:
        number, rest = divmod(number, 36)
        out = _DIGITS[rest] + out
    return out


def segment_id() -> str:
    """Ids that sort as they were made: microseconds in base 36, padded, never the same or an earlier one again."""
    with _lock:
        _last[0] = max(_last[0] + 1, time.time_ns() // 1000)
        return base36(_last[0]).rjust(12, "0")
