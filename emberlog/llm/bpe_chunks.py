"""Byte-level BPE encoding and decoding of whole texts, by overlapping chunks.

A text is cut into chunks that overlap. Each is pre-tokenised on its own. A chunk starts at an arbitrary place, so
its first boundaries may be wrong; the pattern looks at nothing left of a match, so from the first place where the
left chunk's true boundaries and the right chunk's boundaries meet, the right chunk's are true as well. There the
pieces are stitched. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.shared import steps, tidy

#: Code points of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 12, 1 << 8


@lru_cache(2)
def encoder(path: str, pattern: str):
    """A tiktoken encoding without special tokens, from a rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, start: int, end: int, pattern: str) -> list[int]:
    """Where pre-tokens of text[start:end] begin, but for those that the cut at end could change."""
    at = [m.start() for m in _splitter(pattern).finditer(text, start, end)]
    if end < len(text):
        # With more text in sight the last match could go on, or the two last be one ("'l" before "l").
        del at[-2:]
    return at


def cuts(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Pre-token boundaries, about one in each chunk, between which pieces can be encoded apart.

    A cut stands behind a character that isn't white space, so that the piece before it ends as it does in the
    whole text. Where the overlap holds no common boundary, the left chunk is widened until it does.
    """
    places, n = [0], len(text)
    starts = range(0, n, chunk)
    found = [boundaries(text, s, min(n, s + chunk + overlap), pattern) for s in starts]
    true = found[0] if found else []
    k = 1
    while k < len(starts):
        right = set(found[k])
        meet = next((p for p in true if p >= starts[k] and p in right and not text[p - 1].isspace()), None)
        wider = overlap
        while meet is None and k < len(starts):
            wider *= 2
            end = min(n, starts[k] + wider)
            while k + 1 < len(starts) and end > starts[k + 1]:  # this chunk lies inside the widened one
                k += 1
                right = set(found[k])
            true = boundaries(text, places[-1], end, pattern)
            right = right if end < n else set()
            meet = next((p for p in true if p >= starts[k] and p in right and not text[p - 1].isspace()), None)
            if end == n:
                break
        if meet is None:
            break
        places.append(meet)
        true = [p for p in found[k] if p >= meet]
        k += 1
    return [*places, n]


def encode_text(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    own = encoder(path, pattern)
    if len(text) <= chunk:
        return own.encode_ordinary(text)
    places = cuts(text, pattern, chunk, overlap)
    return [i for a, b in zip(places, places[1:]) for i in own.encode_ordinary(text[a:b])]


def decode_ids(ids: list[int], path: str, pattern: str) -> bytes:
    return encoder(path, pattern).decode_bytes(ids)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text. A null text is an empty one: no ids. One row for each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, text_column):
                ids = pa.array([encode_text(x, path, pattern) for x in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(id_column), ids], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, raw): the concatenated bytes of each row's ids; null ids are none."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([decode_ids(x or [], path, pattern) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), raw], names=[id_column, "raw"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each text, decodes its ids, and returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Both steps run in one pass, so that ids are neither shuffled nor sent between processes.
    A null text counts as empty (no tokens, digests of nothing); repeated rows give repeated rows and an empty table
    none. Texts of more than a chunk are cut and stitched, however long. Other columns aren't read.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [str(i) for i in range(encoder(path, pattern).max_token_value + 1)]
        for batch in batches:
            for part, texts in steps(batch, "text"):
                counts, ids_sha, raw_sha = [], [], []
                for text in texts:
                    ids = encode_text(text, path, pattern)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(decode_ids(ids, path, pattern)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
