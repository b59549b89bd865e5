"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands, star-shaped candidate edges.

1. Each text becomes its set of hashed word shingles. One permutation deals them into bins; the least of each bin is
   its value, and an empty bin takes the value of the first filled one in its own random order. Equal sets share a
   set key and are one node from here on.
2. Nodes that agree on all bins of a band are a bucket. Each is tied to the bucket's least node alone, so a bucket
   of n nodes gives n-1 edges. Components of these edges are the candidate clusters: no pair that shares a bucket
   is in two clusters.
3. Inside a cluster, links are confirmed on full sets. A search starts from any node, ties what is similar to it and
   goes on from there; only what isn't tied yet is compared. It finds every component of the true links. A cluster
   above a size is dealt into blocks, and each pair of blocks is a task, so that no task holds more than two blocks.
4. Components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.graph import components
from emberlog.llm.shared import fresh, joined, mix, powers, steps, tidy, written

#: Shingles in one block of a cluster.
BLOCK_SHINGLES = 2_000_000


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order. A text of fewer words is one shingle, of none is empty."""
    data, starts = joined(texts, lower=True)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SPREAD[data] * up[:-1], out=sums[1:])
    own = mix((sums[end] - sums[begin]) * down[begin])
    first = np.searchsorted(begin, starts)
    out = []
    whole = own[: max(0, len(own) - words + 1)].copy()
    for k in range(1, words):
        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - words + 1 + k])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in own[a:b]:
                h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(4)
def _orders(bins: int) -> np.ndarray:
    """For each bin, at which try it asks each other bin."""
    return np.random.default_rng(20).random((bins, bins)).argsort(1).argsort(1).astype(np.int16 if bins < 1 << 15 else np.int32)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin, for ascending hashes; empty bins are filled by optimal densification."""
    place = (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    filled, values = place[first], np.zeros(bins, np.uint64)
    values[filled] = hashes[first]
    empty = np.ones(bins, bool)
    empty[filled] = False
    empty = np.flatnonzero(empty)
    if len(empty):
        values[empty] = values[filled[_orders(bins)[np.ix_(empty, filled)].argmin(1)]]
    return values


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in values.reshape(bands, rows).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def set_key(hashes: np.ndarray) -> int:
    """64 bits that stand for a set."""
    both = mix(mix(hashes).sum(dtype=np.uint64, keepdims=True) + np.array([len(hashes)], np.uint64) * np.uint64(0xA0761D6478BD642F))
    return int(both.view(np.int64)[0])


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """(id, text_key, n_shingles, set_key, bands); the last two are null for an empty set."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, text_column):
                sets = shingle_sets(texts, words)
                keys = [set_key(x) if len(x) else None for x in sets]
                own = [band_keys(signature(x, bands * rows), bands, rows) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), part.column("text_key"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(own, pa.list_(pa.int64()))],
                    names=[id_column, "text_key", "n_shingles", "set_key", "bands"],
                )

    return docs.select(id_column, text_column, F.xxhash64(text_column).alias("text_key")).mapInArrow(run, f"`{id_column}` long, text_key long, n_shingles long, set_key long, bands array<long>")


def confirmed(keys: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of links: pairs with 100 * intersection >= percent * union, that join all that links can join."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flags = np.zeros(int(codes.max()) + 1, np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left, out = np.arange(len(sets)), []
    flat, flat_starts = codes, starts[:-1]
    packed = len(left)
    alive = np.ones(len(sets), bool)
    queue: list[int] = []
    while alive.any() or queue:
        if not queue:
            k = int(left[alive[left]][0]) if alive[left].any() else -1
            alive[k] = False
            queue.append(k)
        hub = queue.pop()
        n_alive = int(alive.sum())
        if not n_alive:
            break
        if n_alive < packed // 2:
            left = np.flatnonzero(alive)
            flat = np.concatenate([codes[starts[i] : starts[i + 1]] for i in left])
            flat_starts = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
            packed = len(left)
        own = codes[starts[hub] : starts[hub + 1]]
        flags[own] = 1
        common = np.add.reduceat(flags[flat], flat_starts, dtype=np.int64)
        flags[own] = 0
        near = left[(100 * common >= percent * (sizes[hub] + sizes[left] - common)) & alive[left]]
        alive[near] = False
        out += [(keys[hub], keys[k]) for k in near.tolist()]
        queue += near.tolist()
    return out


def _confirm(members: DataFrame, words: int, percent: int, text_column: str) -> DataFrame:
    """(a, b): confirmed links of rows (cluster, pair, set_key, text), of which one of a set_key is enough."""

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, text_column):
                found = shingle_sets(texts, words)
                right = [k for k, (x, want) in enumerate(zip(found, part.column("set_key").to_pylist())) if len(x) and set_key(x) == want]
                part = part.take(pa.array(right, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cluster"), part.column("blocks"), part.column("set_key"), pa.array([found[k].tobytes() for k in right], pa.binary())],
                    names=["cluster", "blocks", "set_key", "hashes"],
                )

    @tidy
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done():
            got = confirmed(list(held), list(held.values()), percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for cluster, pair, key, raw in zip(*(batch.column(c).to_pylist() for c in ("cluster", "pair", "set_key", "hashes"))):
                if (cluster, pair) != now:
                    if held:
                        yield done()
                    now, held = (cluster, pair), {}
                held[key] = np.frombuffer(raw, np.uint64)
        if held:
            yield done()

    own = members.select("cluster", "blocks", "set_key", text_column).mapInArrow(sets, "cluster long, blocks int, set_key long, hashes binary")
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    # Block i takes part in the pairs (i, j) and (j, i), each named by its smaller and larger number.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")))
    dealt = own.withColumn("block", block).select("cluster", F.explode(pairs).alias("pair"), "set_key", "hashes")
    return dealt.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "set_key").mapInArrow(links, "a long, b long")


def _resolved(docs: DataFrame, words: int, percent: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """(id, text_key, n_shingles, root, component_id) of each row; root names its group, null for an empty set."""
    sig = written(signatures(docs, words, bands, rows, id_column, text_column), "signatures")
    nodes = written(
        sig.where("set_key is not null").groupBy("set_key").agg(F.min(id_column).alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "sets"
    )
    keys = nodes.select("set_key", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("top")).where("hub <> top").select("key", "hub")
    stars = keys.join(buckets, "key").where("set_key <> hub").select(F.col("set_key").alias("a"), F.col("hub").alias("b"))
    tied = components(stars, "candidates")
    clusters = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    sized = nodes.select(F.col("set_key").alias("node"), "least_id", "n_shingles").join(clusters, "node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = sized.join(blocks, "root").select(F.col("node").alias("set_key"), F.col("least_id").alias("_id"), F.col("root").alias("cluster"), "blocks")
    own = docs.select(F.col(id_column).alias("_own"), text_column)
    with_text = own.join(members, own["_own"].eqNullSafe(members["_id"]))
    links = components(_confirm(with_text, words, percent, text_column), "links")
    roots = nodes.select(F.col("set_key").alias("node"), "least_id").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = roots.join(least, "root").select(F.col("node").alias("set_key"), "root", "component_id")
    found = sig.select(id_column, "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col(id_column)).otherwise(F.col("component_id"))
    return found.select(id_column, "text_key", "n_shingles", "root", component.alias("component_id"))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50, rows: int = 7, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of docs.

    component_id is the smallest id that links reach, the row's own included. A null or empty text has no shingles
    and no links. Rows with equal sets are linked whatever their ids: repeated rows share a component and each is
    kept if its id is the component's; a null id is no component's name, unless all of it are null. At a similarity
    of exactly percent / 100, a pair shares no bucket with probability (1 - s**rows)**bands, and the rest of its
    component may join it all the same.
    """
    found = _resolved(docs, words, percent, bands, rows, id_column, text_column)
    return found.select(id_column, "n_shingles", "component_id", F.col(id_column).eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50, rows: int = 7, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of docs, with their own columns, that are left when one row of each group stays.

    The row with the smallest id stays; of rows with that id, one whatever their other columns hold. Rows without
    words belong to no group and all stay. A row with an id stays rather than one without.
    """
    found = _resolved(docs, words, percent, bands, rows, id_column, text_column).where("root is not null")
    order = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "text_key")
    best = found.groupBy("root").agg(F.min(order).alias("x"))
    own_id, own_key, copies, key = fresh(docs, "_id", "_key", "_copies", "_text_key")
    counted = found.groupBy(F.col(id_column).alias(own_id), F.col("text_key").alias(own_key)).agg(F.count("*").alias(copies))
    first = best.select(F.col("x.id").alias("_best"), F.col("x.text_key").alias("_best_key"))
    kept = written(counted.join(first, F.col(own_id).eqNullSafe(F.col("_best")) & (F.col(own_key) == F.col("_best_key")), "left_semi"), "kept")
    both = docs.withColumn(key, F.xxhash64(text_column)).join(kept, docs[id_column].eqNullSafe(kept[own_id]) & (F.col(key) == F.col(own_key)), "left")
    wordless = F.col(text_column).isNull() | ~F.col(text_column).rlike(r"[^\x20\x09-\x0D]")
    single = both.where(wordless | (F.col(copies) == 1)).select(*(docs[f"`{c}`"] for c in docs.columns))
    if kept.where(F.col(copies) > 1).isEmpty():
        return single
    rest = both.where(~wordless & (F.col(copies) > 1)).dropDuplicates([id_column, key])
    return single.unionByName(rest.select(*(docs[f"`{c}`"] for c in docs.columns)))


def sql(words: int = 3, percent: int = 85) -> str:
    """The same by brute force for DuckDB: all pairs that share a shingle."""
    parts = " || chr(10) || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, chr(10))]
         ELSE list_distinct([{parts} for i in range(1, len(w) - {words} + 2)]) END AS s FROM docs),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (min(a.n) + min(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.c AS component_id, l.c = s.doc_id AS kept FROM sets s JOIN least l ON l.a = s.doc_id"""
