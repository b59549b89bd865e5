"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are lower-cased words with one blank between them, read as characters. Edits of a share of an item leave runs
of characters whole, so each window of a document that begins with a run of an item, its seed, is looked at. From the
seed's edge, forwards and backwards, a CGK walk goes over the characters and at each step repeats or passes one by a
random bit of (step, character); an edit costs a walk little, and texts at a small edit distance become sequences at a
small Hamming distance. A key is the seed and the symbols at sampled steps; several walks make several keys. Keys of
documents meet those of the items in a sorted table.

How long a seed is follows from the distance and the item's length. Items too short for runs that tell anything have
seeds that so many edits can't spoil all at once, and meet by the seed alone.

Each meeting is verified: first a part of the item around it, 64 characters at most, by bit-parallel columns for many
meetings at once; then the whole item, by the least edit distance to any stretch of the document around the meeting.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import joined, mix, release, steps, tidy

#: An item leaks into a text if a stretch of it is at an edit distance of at most this share of the item's length.
DISTANCE = 0.2
#: Lengths of seeds, each for items in which so many runs of that length are expected to stay whole.
SEEDS, WHOLE_RUNS = (8, 6), 2.5
#: Steps of a walk, sampled steps of a key, walks in each direction. Measured on 200 items of 81 to 394 characters, of those
#: within the distance are met: with 20 % of characters replaced, added or left out 0.99, with each word split in two 0.99,
#: with one letter of each word replaced 0.97, with one of each second word or with 15 % edited 1.00.
STEPS, SAMPLED, WALKS = 12, 5, 4
#: Characters of a part, between starts of parts, and what its share of edits may exceed the item's by.
PART, STRIDE, SLACK = 64, 32, 1.5
#: Windows that are walked, and parts that are compared, at once.
HELD, LANES = 1 << 14, 1 << 13
#: Bytes of items that one pass over the documents looks for. A worker's tables take about a hundred times as much.
PASS_BYTES = 1 << 20
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_ODD = np.uint64(0xD6E8FEB86659FD93)


def normalized(texts: list[str]) -> tuple[str, np.ndarray]:
    """(the lower-cased words of all texts, each with one blank behind it, and where each text's begin, with the end)."""
    data, starts = joined([x.lower() for x in texts])
    word = _WORD[data]
    # Signs of U+0080 to U+00BF and of U+2000 to U+207F are no letters.
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0))
    word[two] = word[two + 1] = False
    three = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))
    for k in range(3):
        word[three + k] = False
    kept = word.copy()
    kept[1:] |= word[:-1]
    data = np.where(word, data, np.uint8(32))
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept & (data & 0xC0 != 0x80), out=at[1:])
    # The blank behind a text's last word stands where the next text's gap was.
    return data[kept].tobytes().decode("utf-8", "surrogatepass"), at[np.minimum(starts + 1, len(data))]


def _symbols(text: str) -> np.ndarray:
    """A byte for each character, never 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.maximum((codes * np.uint32(0x9E3779B1)) >> np.uint32(24), np.uint32(1)).astype(np.uint8)


def seed_length(length: int, distance: float = DISTANCE) -> tuple[int, bool]:
    """(length of seeds of an item with so many characters, whether they meet alone)."""
    edits = math.floor(distance * length)
    for n in SEEDS:
        if edits * (1 - distance) ** n >= WHOLE_RUNS:
            return n, False
    return max(1, min(SEEDS[0], length // (edits + 1))), True  # one of edits + 1 stretches is whole


def seeds(symbols: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of that many symbols, eight at most."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    runs = np.ndarray((n,), "<u8", padded, strides=(1,))
    return (runs if size == 8 else runs & np.uint64((1 << 8 * size) - 1)) * _ODD


@lru_cache(16)
def _walk(walk: int) -> tuple[frozenset[int], np.ndarray]:
    rng = np.random.default_rng([8, walk])
    return frozenset(rng.choice(STEPS, SAMPLED, replace=False).tolist()), rng.integers(0, 1 << 64, STEPS, np.uint64) | np.uint64(1)


def embed(symbols: np.ndarray, at: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the sampled steps of CGK walks that begin at the given places, the last places they read).

    A step's bit is the highest one of the symbol times an odd number of that step; no walk passes a 0.
    """
    sampled, factors = _walk(walk)
    at, keys = at.copy(), np.full(len(at), walk + 1, np.uint64)
    final = max(sampled)
    for step in range(final + 1):
        now = symbols[at]
        if step in sampled:
            keys *= np.uint64(0x9E3779B97F4A7C15)
            keys += now
        if step < final:
            at += (now * factors[step] >> np.uint64(63)).view(np.int64)
    return keys, at


def keys(symbols: np.ndarray, found: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each walk the keys of windows with those seeds at those places, and whether the walk read symbols alone.

    symbols, of 64 bits each, has STEPS zeros around it; places count from the first symbol behind them. The first walks go forwards
    from behind the seed, the others backwards from before it.
    """
    back, end = symbols[::-1], len(symbols) - 1
    for walk in range(2 * WALKS):
        own, start = (symbols, at + STEPS + size) if walk < WALKS else (back, end - (at + STEPS - 1))
        key, last = embed(own, start, walk)
        yield mix(key * np.uint64(0x9E3779B97F4A7C15) ^ found), own[last] != 0


@dataclass
class Table:
    """Keys of the windows of items with one length of seed: sorted, with the place of each in the joined items."""

    size: int
    alone: bool
    seed_bits: np.ndarray
    key_bits: np.ndarray
    keys: np.ndarray
    #: Where keys with each value of their highest bits begin, with the end; the place in the items of each key.
    slots: np.ndarray
    places: np.ndarray

    @classmethod
    def build(cls, symbols: np.ndarray, found: np.ndarray, at: np.ndarray, size: int, alone: bool) -> Table:
        if alone:
            own, places = found, at
        else:
            parts = [(k[good], at[good]) for k, good in keys(symbols.astype(np.uint64), found, at, size)]
            own, places = (np.concatenate(x) for x in zip(*parts))
        order, bits = np.argsort(own, kind="stable"), max(8, (2 * len(own)).bit_length())
        slots = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), out=slots[1:])
        return cls(size, alone, _bitmap(found, 32), _bitmap(own, 12), own[order], slots, places[order].astype(np.int32))

    def meet(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the document, places in the items) of all meetings."""
        found = seeds(symbols[STEPS : len(symbols) - STEPS], self.size)
        at = np.flatnonzero(_in(self.seed_bits, found))
        found, out = found[at], []
        wide = symbols if self.alone else symbols.astype(np.uint64)
        for i in range(0, len(at), HELD):
            block, here = found[i : i + HELD], at[i : i + HELD]
            for key, _ in [(block, None)] if self.alone else keys(wide, block, here, self.size):
                few = np.flatnonzero(_in(self.key_bits, key))
                key = key[few]
                slot = (key >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)
                low = self.slots[slot].astype(np.int64)
                count = self.slots[slot + 1] - low
                which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                equal = self.keys[which] == np.repeat(key, count)
                out.append((np.repeat(here[few], count)[equal], self.places[which[equal]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (at, at)


def _bitmap(values: np.ndarray, times: int) -> np.ndarray:
    bits = min(27, max(12, (times * len(values)).bit_length()))
    out = np.zeros(1 << bits, bool)
    out[(values >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def _in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    return bitmap[(values >> np.uint64(65 - len(bitmap).bit_length())).astype(np.int64)]


class Items:
    """What one pass looks for: items as (item_id, text), as normalized texts, and the tables of their windows."""

    def __init__(self, rows: list[tuple[int | None, str | None]], distance: float):
        self.ids, self.texts, self.distance = [], [], distance
        for item_id, text in rows:
            own = normalized([text or ""])[0].rstrip(" ")
            if own:
                self.ids.append(item_id)
                self.texts.append(own)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        # Items stand in one array with STEPS zeros around each.
        self.starts = np.cumsum(np.append(0, self.lengths + STEPS)) + STEPS
        symbols = np.zeros(int(self.starts[-1]), np.uint8)
        for start, text in zip(self.starts.tolist(), self.texts):
            symbols[start : start + len(text)] = _symbols(text)
        kinds = defaultdict(list)
        for k, n in enumerate(self.lengths.tolist()):
            kinds[seed_length(n, distance)].append(k)
        self.tables = []
        for (size, alone), own in sorted(kinds.items()):
            at = np.concatenate([np.arange(self.lengths[k] - size + 1) + self.starts[k] for k in own])
            found = seeds(symbols, size)[at]
            self.tables.append(Table.build(symbols, found, at - STEPS, size, alone))
        #: Parts: where each item's begin, then their places in the item, lengths and bits of 32 classes of symbols.
        counts = np.where(self.lengths > PART, -(-(self.lengths - PART) // STRIDE) + 1, 1)
        self.parts = np.append(0, np.cumsum(counts))
        item = np.repeat(np.arange(len(counts)), counts)
        self.place = np.minimum((np.arange(len(item)) - self.parts[item]) * STRIDE, np.maximum(self.lengths[item] - PART, 0))
        self.part_length = np.minimum(self.lengths[item], PART)
        self.masks = np.zeros((len(item), 33), np.uint64)
        for i in range(int(self.part_length.max(initial=0))):
            live = np.flatnonzero(i < self.part_length)
            self.masks[live, symbols[self.starts[item[live]] + self.place[live] + i] & 31] |= np.uint64(1 << i)

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], distance: float = DISTANCE) -> Items:
        return cls(rows, distance)

    def near(self, classes: np.ndarray, part: np.ndarray, begin: np.ndarray, width: int, distance: float) -> np.ndarray:
        """Whether each part, begun at a place or up to so far before or behind it, is within SLACK times the distance."""
        limit = np.floor(SLACK * distance * self.part_length + 1e-9).astype(np.int64)
        out, flat, one = np.zeros(len(part), bool), self.masks.reshape(-1), np.uint64(1)
        for i in range(0, len(part), LANES):
            own = part[i : i + LANES]
            rows, top = own * 33, (self.part_length[own] - 1).astype(np.uint64)
            at = begin[i : i + LANES] - width
            plus, minus = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64)
            score = self.part_length[own].astype(np.int64)
            best = score.copy()
            for step in range(int(self.part_length[own].max()) + 2 * width):
                eq = flat[rows + classes[np.clip(at + step, 0, len(classes) - 1)]]
                xv = eq | minus
                xh = (((eq & plus) + plus) ^ plus) | eq
                ph, mh = minus | ~(xh | plus), plus & xh
                score += (ph >> top & one).view(np.int64)
                score -= (mh >> top & one).view(np.int64)
                np.minimum(best, score, out=best)
                ph, mh = ph << one, mh << one
                plus, minus = mh | ~(xv | ph), ph & xv
            out[i : i + LANES] = best <= limit[own]
        return out


def edit_distance(pattern: str, text: str) -> int:
    """The least edit distance between pattern and any stretch of text, by bit-parallel columns."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best = score
    return best


def leaks(texts: list[str], items: Items, distance: float = DISTANCE) -> list[tuple[int, int, int]]:
    """(text, item, least edit distance) of each leak."""
    plain, starts = normalized(texts)
    if not plain or not items.ids:
        return []
    own = _symbols(plain)
    symbols = np.concatenate([np.zeros(STEPS, np.uint8), own, np.zeros(STEPS, np.uint8)])
    classes = np.append(own & 31, 32).astype(np.int64)
    places: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for table in items.tables:
        here, there = table.meet(symbols)
        item = np.searchsorted(items.starts, there + STEPS, "right") - 1
        offset = there + STEPS - items.starts[item]
        part = items.parts[item] + np.clip((offset - (PART - table.size) // 2 + STRIDE // 2) // STRIDE, 0, items.parts[item + 1] - items.parts[item] - 1)
        # One of the meetings of a part that stand along nearly one diagonal is enough.
        begin, band = here - offset + items.place[part], 8
        _, one = np.unique((part << 34) | (begin + STEPS * 64 + (1 << 20)) // band, return_index=True)
        width = math.ceil(distance * PART) + band
        one = one[items.near(classes, part[one], begin[one], width, distance)]
        for text, k, low in zip((np.searchsorted(starts, here[one], "right") - 1).tolist(), item[one].tolist(), (here - offset)[one].tolist()):
            size = int(items.lengths[k])
            room = 2 * math.floor(distance * size) + 1
            places[text, k].append((max(low - room, int(starts[text])), min(low + size + room, int(starts[text + 1]))))
    out = []
    for (text, k), stretches in sorted(places.items()):
        pattern, limit, least = items.texts[k], math.floor(distance * len(items.texts[k])), None
        for low, high in _united(sorted(stretches)):
            around = plain[low:high]
            got = 0 if pattern in around else edit_distance(pattern, around)
            if got <= limit and (least is None or got < least):
                least = got
            if least == 0:
                break
        if least is not None:
            out.append((text, k, least))
    return out


def _united(stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    low, high = stretches[0]
    for a, b in stretches[1:]:
        if a > high:
            yield low, high
            low, high = a, b
        high = max(high, b)
    yield low, high


def _passes(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items, in parts of a bounded size of which the driver holds one: a larger benchmark takes more passes."""
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // PASS_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        found = [tuple(r) for r in (rows if n == 1 else rows.where(part == k)).collect()]
        if found:
            yield sorted(found, key=lambda r: (r[0] is not None, r[0], r[1]))


@lru_cache(1)
def _built(sent_id: int, distance: float, rows: tuple) -> Items:
    return Items(list(rows), distance)


def _items(sent, distance: float) -> Items:
    """A worker's tables of one pass: only the items' texts are sent, and each worker builds its own once."""
    return _built(sent.value[0], distance, sent.value[1])


def _sent(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    for k, rows in enumerate(_passes(benchmark)):
        yield docs.sparkSession.sparkContext.broadcast((k, tuple(rows)))  # PASS_BYTES bounds it


def contaminated(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """(doc_id, item_id, edit_distance, similarity): for each row of docs the items that leak into it.

    An item without words leaks nowhere and a null or empty text holds no leak. Repeated rows of docs give their
    pairs again; repeated rows of the benchmark are one item. Whole texts are read however long; of several stretches
    the nearest counts. Empty tables give no row, and other columns aren't read.
    """
    spark, out = docs.sparkSession, None
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    for sent in _sent(docs, benchmark):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _items(sent, distance)
            for batch in batches:
                for part, texts in steps(batch, "text"):
                    found = leaks(texts, own, distance)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array([t for t, _, _ in found], pa.int64())), pa.array([own.ids[i] for _, i, _ in found], pa.int64()),
                            pa.array([d for _, _, d in found], pa.int32()), pa.array([1 - d / len(own.texts[i]) for _, i, d in found], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "edit_distance", "similarity"],
                    )

        found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, item_id long, edit_distance int, similarity double")
        found = found.withColumn("item_id", F.col("item_id").cast(item_type))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, edit_distance int, similarity double")


def keep_clean(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """The rows of docs, with their own columns, into which no item leaks. No row is shuffled.

    Null and empty texts stay, and so do repeated rows; an empty benchmark drops nothing.
    """
    for sent in _sent(docs, benchmark):
        docs = docs.where(_is_clean(sent, distance))
    return docs


def _is_clean(sent, distance: float) -> Column:
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own, flags, at = texts.fillna("").tolist(), np.ones(len(texts), bool), 0
            for _, few in steps(pa.RecordBatch.from_pydict({"t": pa.array(own, pa.string())}), "t"):
                for t, _, _ in leaks(few, _items(sent, distance), distance):
                    flags[at + t] = False
                at += len(few)
            yield pd.Series(flags)
        release()

    return clean(F.col("text"))
