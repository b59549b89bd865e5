"""Exact substring deduplication by collection suffix arrays, built column by column.

A byte goes if it lies in a string of `length` bytes that starts anywhere else as well. Two equal strings have the
same least k-mer (by hash, the leftmost of equals), so the corpus is dealt by that anchor. All strings of a document
with one anchor are a fragment of fewer than two lengths.

1. An anchor that occurs once has nothing to compare. Equal fragments cover each other wholly.
2. Distinct fragments of an anchor are a small collection of documents. Its Burrows-Wheeler transform and longest
   common prefixes grow by one symbol of each document a round, from the right ends, in files that each round reads
   and writes in order. A string with a common prefix of `length` with a neighbour occurs elsewhere.
3. An anchor with very many distinct fragments is dealt anew, by the hash of each single string.

An anchor, fragment or string of very many rows is counted by aggregates that combine before they shuffle, and its
rows are found by broadcasting the few keys of this kind, so that no task takes all rows of one.

Runs of removed bytes are put together for each document at the end.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import joined, mix, powers, steps, written

LENGTH, K = 200, 32
#: Bytes of fragments in one collection, and distinct fragments of an anchor above which its strings are dealt singly.
COLLECTION_BYTES, MANY = 1 << 18, 2048
#: Rows of one key that a task may take. Where there are more than 2**16 times as many rows, it is their 2**16th part,
#: so that keys beyond it number 2**16 at most and can be broadcast.
TOGETHER = 1 << 12
#: Classes by how far a string reaches to the left of its anchor.
STRIPS = 6

_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Column:
    """A column of the collection in a scratch file, read and written from its start to its end in each round."""

    def __init__(self, kind):
        self.file, self.kind, self.size = tempfile.TemporaryFile(prefix="bwt-", buffering=0), np.dtype(kind), 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        out = np.empty(self.size, self.kind)
        view, at = memoryview(out).cast("B"), 0
        while at < len(view):
            at += self.file.readinto(view[at:])
        return out

    def write(self, values: np.ndarray) -> None:
        """Values never get fewer, so the file is written over and not cut."""
        self.file.seek(0)
        view, at = memoryview(np.ascontiguousarray(values, self.kind)).cast("B"), 0
        while at < len(view):
            at += self.file.write(view[at:])
        self.size = len(values)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each document of a collection, at which of its starts stands a string of that length that occurs elsewhere.

    Round j inserts the suffix of j symbols of each document. It stands where its first symbol's occurrence in the
    transform stands among equal symbols. Its common prefix with a neighbour is one more than the least common
    prefix between both occurrences. No two documents' ends are equal.
    """
    sizes = np.array([len(t) for t in texts])
    m, longest = len(texts), int(sizes.max(initial=0))
    if not longest:
        return [np.zeros(0, bool) for _ in texts]
    # Symbols are 1..256 so that 0 is an end; columns stand from the right.
    codes = np.zeros((longest + 1, m), np.uint16)
    for i, t in enumerate(texts):
        codes[: len(t), i] = np.frombuffer(t, np.uint8)[::-1].astype(np.uint16) + 1
    present = np.unique(codes)
    codes = np.searchsorted(present, codes).astype(np.uint8 if len(present) <= 256 else np.uint16)
    with _Column(codes.dtype) as transform, _Column(np.uint16) as prefixes:
        transform.write(codes[0])
        prefixes.write(np.zeros(m, np.uint16))
        at = np.arange(m)  # where each document's last inserted suffix stands
        live = np.arange(m)
        for j in range(1, longest + 1):
            live = live[sizes[live] >= j]
            live = live[np.argsort(at[live])]  # so that places are looked up in order
            bwt, lcp = transform.read(), prefixes.read()
            own = at[live]
            target, low, high = _mapped(bwt, own)
            target += m
            left, right = _least(lcp, low, own, high)
            total = len(bwt) + len(live)
            new = np.zeros(total, bool)
            new[target] = True
            old = ~new
            out = np.empty(total, bwt.dtype)
            out[old] = bwt
            out[target] = codes[j, live]
            common = np.empty(total, np.uint16)
            common[old] = lcp
            common[target] = left
            behind = target + 1
            fits = (high >= 0) & (behind < total)
            # A neighbour that is new as well has its own value, which is the same.
            common[behind[fits]] = right[fits]
            transform.write(out)
            prefixes.write(common)
            at[live] = target
        bwt, lcp = transform.read(), prefixes.read()
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) + m - int(np.count_nonzero(bwt == 0))
    hit = lcp >= length
    hit[:-1] |= hit[1:]
    flags = np.zeros((longest + 1, m), bool)
    here = np.arange(m)
    for j in range(1, longest + 1):
        going = np.flatnonzero(sizes >= j)
        here[going] = place[here[going]]
        flags[j, going] = hit[here[going]]
    return [flags[n:0:-1, i][: max(0, n - length + 1)] for i, n in enumerate(sizes.tolist())]


def _mapped(bwt: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places of the transform: how many lesser symbols but ends there are and equal ones before, and where the
    nearest equal one before and behind stands (-1: nowhere). A stable sort of symbols has all of it side by side."""
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    at, symbols = place[own], bwt[own]
    before, behind = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(order) - 1)]
    low = np.where((at > 0) & (bwt[before] == symbols), before, -1)
    high = np.where((at + 1 < len(order)) & (bwt[behind] == symbols), behind, -1)
    return at.astype(np.int64) - int(np.count_nonzero(bwt == 0)), low, high


def _least(lcp: np.ndarray, low: np.ndarray, own: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more than the least of lcp[low + 1 : own + 1] and of lcp[own + 1 : high + 1]; 0 where low or high is missing."""
    spans = np.stack([np.where(low >= 0, low, own) + 1, own + 1, np.where(high >= 0, high, own) + 1], 1)
    found = np.minimum.reduceat(np.append(lcp, np.uint16(0)), spans.ravel()).reshape(-1, 3) + np.uint16(1)
    return np.where(low >= 0, found[:, 0], np.uint16(0)), np.where(high >= 0, found[:, 1], np.uint16(0))


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of values, from prefix and suffix minima of blocks of that width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def fragments(texts: list[str], length: int, k: int):
    """(document, anchor hash, fragment hash, anchor, first start, last start) of each fragment, as arrays."""
    data, starts = joined(texts)
    n = len(data)
    if n < length:
        return [np.zeros(0, np.int64)] * 6
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SPREAD[data] * up[:-1], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    value = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_window_least(value, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    good = np.ones(len(anchor), bool)  # strings that lie in one document
    gaps = np.zeros(n + 1, np.int32)
    gaps[1:] = np.cumsum(np.bincount(starts, minlength=n)[:n])
    good = gaps[length : length + len(anchor)] == gaps[: len(anchor)]
    first = good.copy()
    first[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
    last = good.copy()
    last[:-1] &= ~good[1:] | (anchor[1:] != anchor[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    a = anchor[lo]
    whole = mix((sums[hi + length] - sums[lo]) * down[lo] + (a - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    doc = np.searchsorted(starts, lo, "right") - 1
    base = starts[doc] + 1
    return [doc, grams[a].view(np.int64), whole.view(np.int64), a - base, lo - base, hi - base]


def _records(docs: DataFrame, length: int, k: int) -> DataFrame:
    """A row for each fragment of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                doc, anchor, whole, at, lo, hi = fragments(texts, length, k)
                index = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(index), part.column("text_key").take(index), pa.array(anchor), pa.array(whole), *(pa.array(x, pa.int32()) for x in (at, lo, hi))],
                    names=["doc_id", "text_key", "anchor", "fragment", "at", "lo", "hi"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, anchor long, fragment long, at int, lo int, hi int")


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, many, doc_id, text_key, at, lo, unsure, raw): the bytes of each wanted fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                rows = []
                for text, doc_id, key, wants in zip(texts, *(part.column(c).to_pylist() for c in ("doc_id", "text_key", "wants"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    rows += [(w["anchor"], w["many"], doc_id, key, w["at"], w["lo"], w["unsure"], raw[w["lo"] : w["hi"] + length]) for w in wants]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                names = ["anchor", "many", "doc_id", "text_key", "at", "lo", "unsure", "raw"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "many", "at", "lo", "hi", "unsure")).alias("wants"))
    lists = lists.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "wants")
    both = docs.join(lists, docs["doc_id"].eqNullSafe(lists["_d"]) & (docs["text_key"] == lists["_k"])).select("doc_id", "text_key", "text", "wants")
    # Rows with one doc_id and text have the same fragments, of which one is fetched.
    return both.mapInArrow(run, "anchor long, many boolean, doc_id long, text_key long, at int, lo int, unsure boolean, raw binary")


_SPAN = "doc_id long, text_key long, start int, stop int"


def _runs(flags: np.ndarray, lo: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the flagged strings cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(lo + a, lo + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "text_key", "start", "stop"])


def _sharing(group: list[tuple], length: int, k: int) -> list[tuple]:
    """The fragments of one anchor, (doc_id, text_key, at, lo, unsure, raw), that can share a string, cut to what can.

    A string reaches over its anchor by length - k bytes, of which `left` stand before it. Whatever strip of STRIPS
    `left` is in, the string holds the bytes that all strings of this strip hold. Where no other fragment has the same
    ones, it shares no string of the strip.
    """
    reach = length - k
    width = -(-(reach + 1) // STRIPS)
    strips = [(i * width, max(0, reach - (i + 1) * width + 1)) for i in range(-(-(reach + 1) // width))]
    cores = []
    for *_, at, lo, _, raw in group:
        p = at - lo
        cores.append([raw[p - left : p + k + right] if left <= p and p + k + right <= len(raw) else None for left, right in strips])
    often = [Counter(own) for own in zip(*cores)]
    out = []
    for (doc_id, key, at, lo, unsure, raw), own in zip(group, cores):
        good = [i for i, core in enumerate(own) if core is not None and often[i][core] > 1]
        if good:
            p = at - lo
            start, stop = max(0, p - (good[-1] + 1) * width + 1), p + k + reach - good[0] * width
            out.append((doc_id, key, lo + start, unsure, raw[start:stop]))
    return out


def _by_collections(few: DataFrame, length: int, k: int) -> DataFrame:
    """Spans of repeated strings, from collections of the fragments of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size, now = 0, None

        def done():
            got = repeated_starts([r[4] for r in held], length)
            return _span_batch([(r[0], r[1], a, b) for r, flags in zip(held, got) if r[3] for a, b in _runs(flags, r[2], length)])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "at", "lo", "unsure", "raw"))):
                if row[0] != now:
                    held += (new := _sharing(group, length, k))
                    size += sum(len(r[4]) for r in new)
                    group = []
                    if size > COLLECTION_BYTES:
                        yield done()
                        held, size = [], 0
                now = row[0]
                group.append(row[1:])
        held += _sharing(group, length, k)
        if held:
            yield done()

    columns = ("anchor", "doc_id", "text_key", "at", "lo", "unsure", "raw")
    return few.repartition("anchor").sortWithinPartitions("anchor").select(*columns).mapInArrow(run, _SPAN)


def _by_strings(many: DataFrame, length: int, together: int) -> DataFrame:
    """Spans of repeated strings of anchors with very many distinct fragments, from the count of each single string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, key, lo, unsure, raws = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "lo", "unsure", "raw"))
            hashes, index, place = [], [], []
            for i, raw in enumerate(raws):
                data = np.frombuffer(raw, np.uint8)
                up, down = powers(len(data) + 1)
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_SPREAD[data] * up[:-1], out=sums[1:])
                hashes.append(mix((sums[length:] - sums[:-length]) * down[: len(data) - length + 1]).view(np.int64))
                index.append(np.full(len(hashes[-1]), i))
                place.append(np.arange(len(hashes[-1]), dtype=np.int32) + lo[i])
            if hashes:
                index = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(index), batch.column("text_key").take(index), batch.column("unsure").take(index), pa.array(np.concatenate(place)), pa.array(np.concatenate(hashes))],
                    names=["doc_id", "text_key", "unsure", "start", "string"],
                )

    own = many.select("doc_id", "text_key", "lo", "unsure", "raw").mapInArrow(run, "doc_id long, text_key long, unsure boolean, start int, string long")
    total = many.agg(F.sum(F.octet_length("raw") - (length - 1))).first()[0] or 0
    counts = written(own.groupBy("string").agg(F.count("*").alias("n")).where("n > 1"), "strings")
    often = _often(own.where("unsure"), counts, ["string"], max(together, total >> 16))
    return often.select("doc_id", "text_key", "start", (F.col("start") + length).alias("stop"))


def _often(rows: DataFrame, counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows whose keys occur more than once, n times by counts. Rows of keys with `most` or more stay where they are."""
    hot = F.broadcast(counts.where((F.col("n") > 1) & (F.col("n") >= most)).select(*keys))
    rest = counts.where((F.col("n") > 1) & (F.col("n") < most)).select(*keys)
    return rows.join(hot, keys, "left_semi").unionByName(rows.join(hot, keys, "left_anti").join(rest, keys, "left_semi"))


def _dealt(records: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """Rows of fragments that occur more than once; and one row of each fragment of anchors where one occurs once, with
    the numbers of the anchor's distinct fragments and of the fragment's rows.

    Whole anchors come together where they have fewer than `most` rows. Of the others, the fragments are counted, and
    those with `most` rows or more are marked in the same pass; only rows of the rest meet the counts by a shuffle.
    """
    most = max(together, records.count() >> 16)
    hot = records.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= most)
    records = records.join(F.broadcast(written(hot.select("anchor", F.lit(True).alias("hot")), "hot")), "anchor", "left")
    one = F.xxhash64("doc_id", "text_key", "at", "lo")
    # Rows of other anchors are one group, which has no key and meets nothing.
    tallies = records.groupBy(F.when(F.col("hot"), F.col("anchor")).alias("anchor"), F.when(F.col("hot"), F.col("fragment")).alias("fragment"))
    tallies = written(tallies.agg(F.count("*").alias("n"), F.min(one).alias("one")), "tallies")
    great = F.broadcast(tallies.where((F.col("n") > 1) & (F.col("n") >= most)).select("anchor", "fragment", F.lit(True).alias("great")))
    rows = records.join(great, ["anchor", "fragment"], "left").withColumn("salt", F.when(F.col("hot"), one).otherwise(F.lit(0)))

    anchor, same = Window.partitionBy("anchor", "salt"), Window.partitionBy("anchor", "salt", "fragment")
    rows = rows.repartition("anchor", "salt").withColumn("in_anchor", F.count("*").over(anchor)).where("hot or in_anchor > 1")
    rows = rows.withColumn("n", F.count("*").over(same)).withColumn("nth", F.row_number().over(same.orderBy("doc_id", "text_key", "at")))
    rows = rows.withColumn("distinct", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(anchor)).withColumn("alone", F.max(F.col("n") == 1).over(anchor))
    found = written(rows.where("hot or n > 1 or alone").drop("salt", "in_anchor"), "fragments")

    cool, crowd = found.where("hot is null"), found.where("hot").drop("n", "distinct", "alone", "nth")
    some = tallies.where((F.col("n") > 1) & (F.col("n") < most)).select("anchor", "fragment")
    places = ["doc_id", "text_key", "anchor", "at", "lo", "hi"]
    sure = [cool.where("n > 1"), crowd.where("great"), crowd.where("great is null").join(some, ["anchor", "fragment"], "left_semi")]
    anchors = tallies.groupBy("anchor").agg(F.count("*").alias("distinct"), F.max(F.col("n") == 1).alias("alone")).where("alone")
    firsts = tallies.join(F.broadcast(anchors), "anchor")
    # Repeated rows share a hash, and distinct leaves one of them.
    chosen = crowd.withColumn("one", one).join(firsts, ["anchor", "fragment", "one"]).select(*places, "distinct", "n").distinct()
    return functools.reduce(DataFrame.unionByName, (x.select(*places) for x in sure)), cool.where("alone and nth = 1").select(*places, "distinct", "n").unionByName(chosen)


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, many: int = MANY, together: int = TOGETHER) -> DataFrame:
    """(doc_id, text_key, start, stop): byte ranges, which may overlap, that repeated strings cover.

    docs has doc_id, text and text_key, a hash of the text.
    """
    sure, wanted = _dealt(written(_records(docs, length, k), "records"), together)
    sure = sure.select("doc_id", "text_key", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    wanted = wanted.withColumns({"many": F.col("distinct") > many, "unsure": F.col("n") == 1}).drop("distinct", "n")
    fetched = written(_fetched(docs, wanted, length).dropDuplicates(["doc_id", "text_key", "lo"]), "collections")
    return sure.unionByName(_by_collections(fetched.where("not many"), length, k)).unionByName(_by_strings(fetched.where("many"), length, together))


def removed(docs: DataFrame, length: int = LENGTH, k: int = K, many: int = MANY, together: int = TOGETHER, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row for each row of docs.

    A null text is empty. Texts shorter than length lose nothing. Two rows with the same text of that length or more
    lose all of it, whatever their doc_ids; a null doc_id is a document like any other. kept holds the bytes that are
    left, which need not be whole characters. Whole texts are read, however long; an empty table gives no row and
    other columns aren't read.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(own, length, k, many, together).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                rows = []
                for text, own_spans in zip(texts, part.column("spans").to_pylist()):
                    raw, kept, end, n = text.encode("utf-8", "surrogatepass"), [], 0, 0
                    for a, b in sorted((s["start"], s["stop"]) for s in own_spans or ()):
                        if a > end or not n:
                            kept.append(raw[end:a])
                            n += 1
                        end = max(end, b)
                    rest = b"".join([*kept, raw[end:]])
                    rows.append((len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=names)

    joined_ = own.join(spans, own["doc_id"].eqNullSafe(spans["_d"]) & (own["text_key"] == spans["_k"]), "left").select("doc_id", "text", "spans")
    out = joined_.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def sql(length: int = LENGTH) -> str:
    """The same for DuckDB: every string of `length` bytes, by the MD5 of its bytes."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT r, i, md5(substr(h, 2 * i - 1, {2 * length})) AS s FROM docs, unnest(range(1, n - {length - 2})) AS t(i)),
often AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT r, i FROM strings SEMI JOIN often USING (s)),
parted AS (SELECT r, i, coalesce(i - lag(i) OVER w > {length}, true) AS new FROM hits WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT r, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS k FROM parted),
spans AS (SELECT r, k, min(i) AS a, max(i) + {length} AS b FROM numbered GROUP BY r, k),
placed AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 1) AS before FROM spans),
gone AS (
  SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS stop, string_agg(substr(h, 2 * before - 1, 2 * (a - before)), '' ORDER BY k) AS kept
  FROM placed JOIN docs USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * stop - 1) END)) AS kept_sha256
FROM docs LEFT JOIN gone USING (r)"""
