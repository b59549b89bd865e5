"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character n-grams have learned vectors; a document is their mean, and a softmax layer on
it gives the classes. Training is stochastic gradient descent in numpy on a bounded sample of labelled rows. As the
output layer is linear, a trained model is folded to one weight for each hash bucket, and scoring adds up weights over
the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import joined, mix, powers, release, steps, tidy

#: Labelled rows that training takes at most, chosen by a hash of their doc_id.
TRAINING_ROWS = 3000
BUCKETS_LOG2, DIMENSIONS, EPOCHS, RATE = 17, 8, 6, 1.0
#: Zero vectors that each mean takes in, so that a few words don't decide; step of input vectors by that of the output.
PADDING, SPREAD = 30, 20.0
N_GRAMS = (3, 4)


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """For each kind of feature its hash buckets, which of them count, and their places in the joined text (None: one
    at each byte); lastly where texts start."""
    data, starts = joined(texts)
    shift = np.uint32(32 - BUCKETS_LOG2)
    white = data <= 32
    text = np.where(white, np.uint8(32), data)
    h = text.astype(np.uint32)
    good = np.ones(len(text), bool)  # no white space inside
    for size in range(2, max(N_GRAMS) + 1):
        rest = len(text) - size + 1
        h = h[:rest] * np.uint32(0x01000193) + text[size - 1 :]
        good = good[:rest]
        if size > 2:
            good = good & ~white[size - 2 : size - 2 + rest]
        if size in N_GRAMS and rest > 0:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift, good, None
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, end = edge[::2], edge[1::2]  # the joined text begins and ends with a blank
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * down[begin])
    top = np.uint64(64 - BUCKETS_LOG2)
    yield (words >> top).astype(np.uint32), np.ones(len(words), bool), begin
    if len(words) > 1:
        # A word right after itself is one feature, whatever the word.
        pairs = np.where(words[1:] == words[:-1], np.uint64(0x5EED << 47), mix(words[1:] * np.uint64(3) + words[:-1]))
        within = np.ones(len(pairs), bool)
        within[np.searchsorted(begin, starts[1:-1]) - 1] = False
        yield (pairs >> top).astype(np.uint32), within, begin[1:]
    yield np.zeros(0, np.uint32), np.zeros(0, bool), starts


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Chance of label 1 of each text; one without features has the output layer's bias alone."""
        *kinds, (_, _, starts) = _features(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, good, at in kinds:
            edge = np.minimum(starts if at is None else np.searchsorted(at, starts), len(bucket))
            for out, x in ((total, np.where(good, self.weights[bucket], np.float32(0))), (count, good)):
                cum = np.zeros(len(x) + 1)
                np.cumsum(x, out=cum[1:], dtype=np.float64)
                out += np.diff(cum[edge])
        return 1 / (1 + np.exp(-np.clip(total / (count + PADDING) + self.bias, -500, 500)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fits the model; with a single class, its bias says that class and with no row it says one half."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BUCKETS_LOG2, np.float32), 0.0 if not len(y) else 8.0 if y[0] else -8.0)
    rows = []
    for text in texts:
        *kinds, _ = _features([text])
        bucket, counts = np.unique(np.concatenate([b[g] for b, g, _ in kinds]), return_counts=True)
        rows.append((bucket, (counts / (counts.sum() + PADDING)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    done, all_steps = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            rate = np.float32(RATE * (1 - done / all_steps))
            done += 1
            bucket, share = rows[k]
            mean = share @ vectors[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            error = ((p / p.sum()) - np.eye(2, dtype=np.float32)[y[k]]) * rate
            back = out @ error
            out -= np.outer(mean, error)
            vectors[bucket] -= share[:, None] * (back * SPREAD)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def is_held_out(doc_id: Column) -> Column:
    """Remainder 1 of crc32(doc_id as text) by 3; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Trains on at most about `rows` labelled documents that aren't held out.

    They are chosen by a hash of doc_id with a threshold from the number of labels, so that their number is bounded
    at any size. Labels that contradict each other for a doc_id are averaged; null labels are left out. Of documents
    that share a doc_id the least text is taken, so that no doc_id brings more than one row to the driver. The sample
    is small enough to broadcast, and so the texts aren't shuffled. Without labelled rows the model knows nothing and
    gives one half.
    """
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id")))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    few = known if share == 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < int(share * (1 << 62)))
    few = few.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    both = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    found = both.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label")).limit(4 * rows).toPandas().sort_values("doc_id")
    return train([x or "" for x in found["text"]], found["_label"].tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, repeated rows included; an empty table gives none.

    A null text is an empty one and gets the score that no features give. Whole texts are scored, however long; other
    columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 floats, whatever the input's size

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                got = sent.value.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their own columns, that the model doesn't reject (score >= 0.5).

    Null texts are judged like empty ones; repeated rows are kept or dropped alike.
    """

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own, out, at = texts.fillna("").tolist(), [], 0
            for _, few in steps(pa.RecordBatch.from_pydict({"t": pa.array(own, pa.string())}), "t"):
                out.append(model.scores(few))
                at += len(few)
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        release()

    return docs.where(scores(F.col("text")) >= 0.5)
