"""Token ids in shards, each one compressed file that holds a wavelet matrix.

A wavelet matrix has one row of bits for each bit of a symbol, the highest first; each row is stably sorted by the
bit of the row above. With counts of ones for each block of a row, access, rank and select take one step a row and
the file needs no other copy of the ids. Symbols are ids' ranks among the distinct ids of the shard, so a shard has no
more rows than its own ids need.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.pretokens import code_points, is_word, pretoken_starts
from emberlog.llm.shared import filesystem, new_path, span_hashes, steps

MAGIC = b"EWM1"
#: Bits between stored counts of ones.
BLOCK = 512
#: Bytes of text that go into one shard.
SHARD_BYTES = 16 << 20
#: Distinct pre-tokens that a worker keeps encoded.
KEPT = 1 << 20
#: Words that the library encodes in one text.
TOGETHER = 512


class WaveletMatrix:
    """Succinct sequence of ids: alphabet has the distinct ones in order, and rows the bits of their ranks in it."""

    def __init__(self, n: int, alphabet: np.ndarray, rows: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.n, self.alphabet, self.rows, self.zeros, self.ranks = n, alphabet, rows, zeros, ranks
        self.levels = len(rows)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32) if n else np.zeros(0, np.uint32)
        levels = max(1, (len(alphabet) - 1).bit_length()) if n else 0
        kind = np.uint16 if levels <= 16 else np.uint32
        code = np.zeros(len(seen), kind)
        code[alphabet] = np.arange(len(alphabet), dtype=kind)
        now = code[ids]
        width = -(-n // BLOCK) * BLOCK // 8
        rows, zeros = np.zeros((levels, width), np.uint8), np.zeros(levels, np.int64)
        ranks = np.zeros((levels, width * 8 // BLOCK + 1), np.uint32)
        for level in range(levels):
            bit = (now & kind(1 << (levels - 1 - level))).view(kind) != 0
            packed = np.packbits(bit, bitorder="little")
            rows[level, : len(packed)] = packed
            np.cumsum(np.bitwise_count(rows[level]).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32), out=ranks[level, 1:])
            low = now[~bit]
            zeros[level] = len(low)
            now = np.concatenate([low, now[bit]])
        return cls(n, alphabet, rows, zeros, ranks)

    def _code(self, symbol: int) -> int:
        """The rank of an id in the alphabet; -1 if the sequence lacks it."""
        k = int(np.searchsorted(self.alphabet, symbol))
        return k if k < len(self.alphabet) and self.alphabet[k] == symbol else -1

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.rows[level, at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a row."""
        at = np.asarray(at, np.int64)
        block = at // BLOCK
        inside = np.arange(BLOCK)
        bits = np.unpackbits(self.rows[level].reshape(-1, BLOCK // 8)[np.minimum(block, self.rows.shape[1] * 8 // BLOCK - 1)], axis=-1, bitorder="little")
        return self.ranks[level, block].astype(np.int64) + np.where(inside < (at % BLOCK)[..., None], bits, 0).sum(-1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The symbols at the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels if len(at) else 0):
            bit, ones = self._bit(level, at), self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return self.alphabet[out].astype(np.int64)

    def rank(self, symbol: int, at: int) -> int:
        """Occurrences of symbol before place at."""
        code = self._code(symbol)
        if code < 0:
            return 0
        low, high = 0, at
        for level in range(self.levels):
            ones = self._ones(level, np.array([low, high]))
            low, high = (self.zeros[level] + ones if code >> (self.levels - 1 - level) & 1 else np.array([low, high]) - ones).tolist()
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Where the k-th occurrence (from 0) of symbol is; -1 if there are fewer."""
        if k < 0 or k >= self.count(symbol):
            return -1
        low, code = 0, self._code(symbol)
        for level in range(self.levels):
            ones = int(self._ones(level, np.array([low]))[0])
            low = int(self.zeros[level]) + ones if code >> (self.levels - 1 - level) & 1 else low - ones
        at = low + k
        for level in reversed(range(self.levels)):
            if code >> (self.levels - 1 - level) & 1:
                at = self._select_bit(level, at - int(self.zeros[level]), 1)
            else:
                at = self._select_bit(level, at, 0)
        return at

    def _select_bit(self, level: int, k: int, bit: int) -> int:
        counts = self.ranks[level].astype(np.int64)
        counts = counts if bit else np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.rows[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - counts[block]])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def all(self) -> np.ndarray:
        """The whole sequence: each row is put back into the order of the one above it, from the lowest up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self.rows[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[~bit] = out[: self.zeros[level]]
            above[bit] = out[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            out = above
        return self.alphabet[out]


def pack(wavelet: WaveletMatrix, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """A file: magic, size of the head, head (JSON), then the compressed parts that the head names."""
    parts = {
        "doc_ids": np.array([0 if x is None else x for x in doc_ids], np.int64), "nulls": np.array([x is None for x in doc_ids], np.uint8),
        "ends": ends.astype(np.int64), "alphabet": wavelet.alphabet, "zeros": wavelet.zeros, "ranks": wavelet.ranks, "rows": wavelet.rows,
    }
    squeeze = zstandard.ZstdCompressor(level=1)
    packed = {k: squeeze.compress(np.ascontiguousarray(v).tobytes()) for k, v in parts.items()}
    head = json.dumps({"n": wavelet.n, "levels": wavelet.levels, "parts": [[k, len(v)] for k, v in packed.items()]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed.values()])


def unpack(raw: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(wavelet matrix, doc ids, where each document ends) of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = 8 + struct.unpack("<I", raw[4:8])[0]
    head, parts = json.loads(raw[8:at]), {}
    for name, size in head["parts"]:
        parts[name] = zstandard.ZstdDecompressor().decompress(raw[at : at + size])
        at += size
    get = lambda name, kind: np.frombuffer(parts[name], kind)
    levels = head["levels"]
    rows, ranks = (get(name, kind).reshape(levels, -1) if levels else np.zeros((0, 0), kind) for name, kind in (("rows", np.uint8), ("ranks", np.uint32)))
    wavelet = WaveletMatrix(head["n"], get("alphabet", np.uint32), rows, get("zeros", np.int64), ranks)
    return wavelet, [None if z else x for x, z in zip(get("doc_ids", np.int64).tolist(), get("nulls", np.uint8))], get("ends", np.int64)


@lru_cache(1)
def tokenizer(path: str):
    """The tokenizers library's tokenizer, as it comes."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PretokenEncoder:
    """Encodes texts with the tokenizers library, each distinct pre-token once.

    Merges never cross pre-tokens, so the ids of a text are its pre-tokens' ids one after another. Pre-tokens are
    told apart by a 64-bit hash of their code points and their length. A text that holds the string of an added token,
    which the library takes out before it pre-tokenises, goes to the library as a whole.
    """

    def __init__(self, path: str):
        self.path, self.library = path, tokenizer(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        vocabulary = self.library.get_vocab()
        #: Ids of tokens that begin with a blank.
        self.blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.blank[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start, with the end)."""
        whole = "".join(texts)
        if not any(t in whole for t in self.added):
            return self._encode(texts, whole)
        own = [k for k, x in enumerate(texts) if any(t in x for t in self.added)]
        rest = [*texts]
        for k in own:
            rest[k] = ""
        ids, starts = self._encode(rest, "".join(rest))
        found = [np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32) for k in own]
        sizes = [len(x) for x in found]
        more = np.zeros(len(starts), np.int64)
        more[np.array(own) + 1] = sizes
        return np.insert(ids, np.repeat(starts[own], sizes), np.concatenate(found)), starts + np.cumsum(more)

    def _encode(self, texts: list[str], whole: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > KEPT:
            self.__init__(self.path)
        cp, text_starts = code_points(texts)
        at = pretoken_starts(cp, text_starts)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(at[1:], len(cp))
        hashes = span_hashes(cp, at, ends) + (ends - at).astype(np.uint64)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[place] != keys
        new |= place == len(self.keys)
        if new.any():
            self._keep(keys[new], place[new], at[where[new]], ends[where[new]], whole, cp)
            place += np.cumsum(new) - new
        own, sizes = self.at[place], self.size[place][back]
        cum = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=cum[1:])
        ids = self.flat[np.repeat(own[back] - cum[:-1], sizes) + np.arange(cum[-1])]
        return ids, cum[np.searchsorted(at, text_starts)]

    def _keep(self, keys: np.ndarray, place: np.ndarray, at: np.ndarray, ends: np.ndarray, whole: str, cp: np.ndarray) -> None:
        ids, sizes = self._library(at, ends, whole, is_word(cp, at, ends))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, place, sizes)
        self.used += len(ids)

    def _library(self, at: np.ndarray, ends: np.ndarray, whole: str, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each pre-token has). Words with their blank are encoded side by side, many in one text: they
        stay pre-tokens of their own there, and the tokens that begin with a blank tell where each begins."""
        pieces = [whole[a:b] for a, b in zip(at.tolist(), ends.tolist())]
        words, rest = np.flatnonzero(word).tolist(), np.flatnonzero(~word).tolist()
        lines = ["".join(map(pieces.__getitem__, words[i : i + TOGETHER])) for i in range(0, len(words), TOGETHER)]
        ids = np.array([k for x in self.library.encode_batch_fast(lines, add_special_tokens=False) for k in x.ids], np.uint32)
        first = np.flatnonzero(self.blank[ids])
        if len(first) != len(words):  # the library sees other letters
            words, rest, ids, first = [], range(len(pieces)), ids[:0], first[:0]
        alone = [x.ids for x in self.library.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)]
        sizes = np.zeros(len(pieces), np.int64)
        sizes[words] = np.diff(np.append(first, len(ids)))
        sizes[rest] = [len(x) for x in alone]
        ends = np.cumsum(sizes)
        out, in_word = np.zeros(int(ends[-1]), np.uint32), np.zeros(len(pieces), bool)
        in_word[words] = True
        flags = np.repeat(in_word, sizes)
        out[flags] = ids
        out[~flags] = [k for x in alone for k in x]
        return out, sizes


@lru_cache(1)
def pretoken_encoder(path: str) -> PretokenEncoder:
    return PretokenEncoder(path)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int]]:
    """Encodes every whole text in ascending doc_id order into files of folder; returns (shard, documents, ids) of each.

    A null text is empty; each document's ids end with end_id. Null doc_ids come first, equal ones stand in order of
    their texts. Shards follow doc_id ranges of about shard_bytes of text. A file's name and content depend on its
    shard alone and it appears in one step, so a task that runs again does no harm. The driver gets one row a shard.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(-(-total // shard_bytes)) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, doc_ids, all_ids, sizes = pretoken_encoder(tokenizer_path), [], [], []
        for batch in batches:
            for part, texts in steps(batch, "text"):
                ids, starts = own.encode(texts)
                all_ids.append(np.insert(ids, starts[1:], end_id).astype(np.uint32))
                sizes += (np.diff(starts) + 1).tolist()
                doc_ids += part.column("doc_id").to_pylist()
        if not doc_ids:
            return
        ids, shard = np.concatenate(all_ids), TaskContext.get().partitionId()
        all_ids.clear()
        raw = pack(WaveletMatrix.build(ids), doc_ids, np.cumsum(sizes))
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        temporary = f"{path}/.{shard:06d}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(temporary) as out:
            out.write(raw)
        files.move(temporary, f"{path}/{shard:06d}.ewm")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [len(doc_ids)], "ids": [len(ids)]})

    dealt = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(tuple(r) for r in dealt.mapInArrow(run, "shard long, documents long, ids long").collect())


def load(folder: str, shard: int) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    files, path = filesystem(folder)
    with files.open_input_stream(f"{path}/{shard:06d}.ewm") as raw:
        return unpack(raw.read())


def digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards into the shared folder, reads them back and returns doc_id, start, n_tokens and ids_crc32.

    start counts the ids of all documents before. Empty and null texts have the end id alone; an empty table gives no
    row; rows that share a doc_id give a row each.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "wavelet")
    shards = write(docs, tokenizer_path, folder, end_id, shard_bytes)
    names = [s for s, _, _ in shards]
    before = np.concatenate([[0], np.cumsum([n for _, _, n in shards], dtype=np.int64)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                wavelet, doc_ids, ends = load(folder, names[k])
                ids = wavelet.all().astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + before[k]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
