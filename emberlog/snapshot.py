"""A store as it was at a sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberlog.model import Bound


class Snapshot:
    """Reads see versions older than seqno. While it is open, compaction keeps what it can see."""

    def __init__(self, store, seqno: int):
        self.store, self.seqno, self._open = store, seqno, True
        store.snapshots.append(seqno)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._open:
            self._open = False
            self.store.snapshots.remove(self.seqno)

    def get(self, key: bytes | str) -> bytes | None:
        return self.store.get(key, self.seqno)

    def contains_key(self, key: bytes | str) -> bool:
        return self.store.contains_key(key, self.seqno)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return self.store.multi_get(keys, self.seqno)

    def iter(self, reverse: bool = False) -> DataFrame:
        return self.store.iter(self.seqno, reverse)

    def range(self, start: bytes | str, end: bytes | str, reverse: bool = False) -> DataFrame:
        return self.store.range(start, end, self.seqno, reverse)

    def between(self, low: Bound, high: Bound, reverse: bool = False) -> DataFrame:
        return self.store.between(low, high, self.seqno, reverse)

    def prefix(self, start: bytes | str, reverse: bool = False) -> DataFrame:
        return self.store.prefix(start, self.seqno, reverse)

    def first_key_value(self) -> tuple[bytes, bytes] | None:
        return self.store.first_key_value(self.seqno)

    def last_key_value(self) -> tuple[bytes, bytes] | None:
        return self.store.last_key_value(self.seqno)

    def is_empty(self) -> bool:
        return self.store.is_empty(self.seqno)

    def len(self) -> int:
        return self.store.len(self.seqno)

    __len__ = len
