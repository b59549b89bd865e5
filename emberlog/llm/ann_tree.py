"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is filed under a leaf. A query walks the tree best branch first
through a priority queue and so gets leaves in the order of their promise. How many leaves are visited is calibrated:
a bounded set of queries is answered by brute force over all vectors, and the visits are widened until the leaves
hold the wanted share of the true neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import written

#: Vectors in the sample that fits the tree, queries that calibrate it, vectors aimed at in a leaf, leaves at most.
SAMPLE, CALIBRATION, LEAF, LEAVES = 20_000, 200, 1024, 2048
FANOUT, RECALL = 8, 0.96
#: Vectors, and queries, that are multiplied at once.
BLOCK = 2048


@dataclass
class Tree:
    """Nodes with centres; children[i] are the nodes below i, none for a leaf; leaf[i] is its number."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector is filed under: at each node the nearest centre below."""
        out, work = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while work:
            node, rows = work.pop()
            below = self.children[node]
            if not len(below):
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[below]
                nearest = ((c**2).sum(1) - 2 * vectors[rows] @ c.T).argmin(1)
                work += [(int(b), rows[nearest == k]) for k, b in enumerate(below)]
        return out

    def leaves(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """For each query the leaves to visit, the best first, from a priority queue over branches (-1: no more)."""
        out, scores = np.full((len(vectors), visits), -1, np.int32), vectors @ self.centres.T
        for row, own in zip(out, scores):
            queue, k = [(0.0, 0)], 0
            while queue and k < visits:
                _, node = heapq.heappop(queue)
                if len(self.children[node]):
                    for b in self.children[node]:
                        heapq.heappush(queue, (-own[b], int(b)))
                else:
                    row[k] = self.leaf[node]
                    k += 1
        return out


def fit(sample: np.ndarray, leaves: int, seed: int = 11) -> Tree:
    """Splits by k-means until nodes hold a leaf's share of the sample; equal vectors aren't split."""
    rng, share = np.random.default_rng(seed), max(1, len(sample) // max(1, leaves))
    centres, children, leaf = [sample.mean(0) if len(sample) else np.zeros(0)], [np.zeros(0, np.int64)], [-1]
    work, n_leaves = [(0, sample)], 0
    while work:
        node, own = work.pop()
        k = min(FANOUT, -(-len(own) // share))
        parts = []
        if k > 1:
            c = own[rng.choice(len(own), k, replace=False)]
            for _ in range(10):
                label = ((c**2).sum(1) - 2 * own @ c.T).argmin(1)
                c = np.stack([own[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
            parts = [own[label == i] for i in range(k) if (label == i).any()]
        if len(parts) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        first = len(centres)
        children[node] = np.arange(first, first + len(parts))
        centres += [p.mean(0) for p in parts]
        children += [np.zeros(0, np.int64)] * len(parts)
        leaf += [-1] * len(parts)
        work += list(zip(range(first, first + len(parts)), parts))
    return Tree(np.stack(centres), children, np.array(leaf))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(scores: np.ndarray, ids: list[list[int]], least: np.ndarray, vectors: np.ndarray, query: np.ndarray, top: int) -> list[tuple[float, int]]:
    """The top (score, id) of one query: highest score first, then smallest id; scores are recomputed pair by pair."""
    k = min(top, len(scores))
    border = np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9 * (1 + abs(scores).max())
    near = np.flatnonzero(scores >= border)
    exact = (vectors[near] * query).cumsum(1)[:, -1]  # component by component, as SQL adds up
    order = np.lexsort((least[near], -exact))[:top]
    found = [(-float(exact[o]), i) for o in order for i in ids[near[o]]]
    return [(-s, i) for s, i in sorted(found)[:top]]


def _pairs(batch: list[tuple[float, int]]) -> dict[str, list]:
    return {"ids": [i for _, i in batch], "scores": [s for s, _ in batch]}


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, a vector that isn't empty or zero, no null or non-finite component."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))


def sampled(rows: DataFrame, column: str, share: float, salt: int = 0) -> DataFrame:
    """The rows whose hashed column falls into a share of 62 bits, fine enough for any number of rows."""
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 62)) < int(share * (1 << 62)))


def search(
    vectors: DataFrame, top: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest vectors by inner product, its own row left out.

    Queries are rows whose id is divisible by `every`. Ties go to the smaller id; fewer candidates give fewer rows;
    an empty table gives none. Rows that `valid` leaves out take no part. Equal vectors are one entry of the index
    that carries its top + 1 smallest ids, which is all of it that any result can hold, so copies make no leaf or
    query heavy. Rows that repeat an id are candidates and queries of their own. Vectors of each length are a
    collection of their own, as there is no inner product between lengths. Other columns aren't read.
    """
    rows = written(valid(vectors, id_column, vector_column).withColumn("h", F.xxhash64("v")), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()) or [0]
    found = [_searched(rows.where(F.size("v") == n), top, every, recall, sample, leaf) for n in lengths]
    return reduce(DataFrame.unionByName, found)


def _searched(rows: DataFrame, top: int, every: int, recall: float, sample: int, leaf: int) -> DataFrame:
    spark, more = rows.sparkSession, top + 1
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("nth") <= more)
    entries = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = written(entries.withColumn("entry", F.element_at("ids", 1)), "entries")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h", "v").join(entries.select("h", "v", "entry"), ["h", "v"])
    asked = written(asked.select("query_id", "entry", "v"), "queries")
    queries = asked.dropDuplicates(["entry"]).select("entry", "v")
    n = entries.count()
    chosen = sampled(entries, "h", sample / max(n, 1)).select("v").limit(2 * sample).toPandas()["v"]
    if n and not len(chosen):
        raise ValueError("an empty sample can't fit the tree")
    fitted = fit(np.array(chosen.tolist(), np.float64) if len(chosen) else np.zeros((0, 1)), min(LEAVES, max(1, n // leaf)))
    tree = spark.sparkContext.broadcast(fitted)  # LEAVES bounds it
    visits = _calibrated(entries, queries, fitted, more, recall) if n else 1

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = pa.array(tree.value.route(_matrix(batch.column("v"))), pa.int32())
                yield pa.RecordBatch.from_arrays([leaves, *batch.columns], names=["leaf", *batch.schema.names])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = tree.value.leaves(_matrix(batch.column("v")), visits)
                yield pa.RecordBatch.from_arrays([pa.array([r[r >= 0].tolist() for r in leaves], pa.list_(pa.int32())), *batch.columns], names=["leaves", *batch.schema.names])

    filed = written(entries.select("entry", "ids", "v").mapInArrow(file, "leaf int, entry long, ids array<long>, v array<double>"), "index")
    sent = queries.mapInArrow(visit, "leaves array<int>, entry long, v array<double>").select("entry", "v", F.explode("leaves").alias("leaf"))
    # A leaf is dealt into blocks of vectors; each of its queries goes to all of them.
    blocks = filed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = filed.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "entry", "ids", "v")
    right = sent.join(blocks, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "entry", F.array().cast("array<long>").alias("ids"), "v"
    )

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # a cell's vectors stand before its queries
        matrix, least, ids = np.zeros((0, 0)), np.zeros(0, np.int64), []
        for batch in batches:
            out_entry, out = [], []
            if not batch.num_rows:
                continue
            leaves, blocks, kinds = (batch.column(c).to_numpy() for c in ("leaf", "block", "kind"))
            v, entries_ = _matrix(batch.column("v")), batch.column("entry").to_pylist()
            edge = np.flatnonzero((np.diff(leaves) != 0) | (np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(leaves)]):
                if (leaves[a], blocks[a]) != now:
                    now, held, ids = (leaves[a], blocks[a]), [], []
                if kinds[a] == 0:
                    held.append(v[a:b])
                    ids += batch.column("ids").slice(a, b - a).to_pylist()
                    continue
                if held:
                    matrix, least, held = np.concatenate(held), np.array([x[0] for x in ids]), []
                for i in range(a, b, BLOCK) if ids else ():
                    few = v[i : min(b, i + BLOCK)]
                    out_entry += entries_[i : i + len(few)]
                    out += [_pairs(_best(scores, ids, least, matrix, query, more)) for scores, query in zip(few @ matrix.T, few)]
            yield _found(out_entry, out)

    dealt = left.unionByName(right).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "entry")
    found = dealt.mapInArrow(cells, "entry long, ids array<long>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out_entry, out = [], []
            for entry, own_ids, scores in zip(*(batch.column(c).to_pylist() for c in ("entry", "ids", "scores"))):
                if entry != now:
                    if now is not None:
                        out_entry.append(now)
                        out.append(_pairs(held))
                    now, held = entry, []
                held = [(-s, i) for s, i in heapq.nsmallest(more, [(-s, i) for s, i in [*held, *zip(scores, own_ids)]])]
            yield _found(out_entry, out)
        if now is not None:
            yield _found([now], [_pairs(held)])

    tops = found.repartition("entry").sortWithinPartitions("entry").mapInArrow(merge, "entry long, ids array<long>, scores array<double>")
    tops = tops.select("entry", F.arrays_zip("ids", "scores").alias("near"))
    # One occurrence of the query's own id is its row; a repeated row stays a candidate.
    own = F.array_position(F.transform("near", lambda x: x["ids"]), F.col("query_id"))
    rest = F.filter("near", lambda x, i: (own == 0) | (i != own - 1))
    out = asked.select("query_id", "entry").join(tops, "entry").select("query_id", F.posexplode(F.slice(rest, 1, top)).alias("k", "x"))
    return out.select("query_id", (F.col("k") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _found(entries: list[int], near: list[dict]) -> pa.RecordBatch:
    columns = [pa.array(entries, pa.int64()), pa.array([x["ids"] for x in near], pa.list_(pa.int64())), pa.array([x["scores"] for x in near], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["entry", "ids", "scores"])


def _calibrated(entries: DataFrame, queries: DataFrame, tree: Tree, more: int, recall: float) -> int:
    """Leaves to visit so that the share of true neighbours found reaches recall, measured over all vectors."""
    n = queries.count()
    few = sampled(queries, "entry", CALIBRATION / max(n, 1), 3).limit(2 * CALIBRATION).collect()
    if not few:
        if n:
            raise ValueError("an empty sample can't calibrate the visits")
        return 1
    asked = np.array([r["v"] for r in few], np.float64)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in asked]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"))
            leaves, scores = tree.route(vectors), asked @ vectors.T
            k = min(more, len(vectors))
            for own, row in zip(best, scores):
                near = np.argpartition(-row, k - 1)[:k]
                own += list(zip(row[near].tolist(), leaves[near].tolist()))
                own[:] = heapq.nlargest(more, own)
        flat = [(q, s, leaf) for q, own in enumerate(best) for s, leaf in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int32()))], names=["q", "score", "leaf"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    true = entries.select("v").mapInArrow(brute, "q int, score double, leaf int").withColumn("r", rank).where(F.col("r") <= more).select("q", "leaf").collect()
    n_leaves = int(tree.leaf.max()) + 1
    order = tree.leaves(asked, n_leaves)
    needs = np.sort([int(np.flatnonzero(order[r["q"]] == r["leaf"])[0]) + 1 for r in true])
    visits = 1
    while visits < n_leaves and np.searchsorted(needs, visits, "right") < recall * len(needs):
        visits += 1
    return visits


def sql(top: int = 20, every: int = 20) -> str:
    """The exact neighbours for DuckDB: what a search that misses none returns."""
    return f"""
WITH fine AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM fine q JOIN fine c ON len(q.v) = len(c.v) AND q.r <> c.r WHERE q.vec_id % {every} = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {top}"""
