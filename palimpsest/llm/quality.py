"""Quality classifier of supervised subword embeddings.

Words and their character n-grams are hashed to learned vectors; a word's vector is the sum of
its own, a document's the average of its words', and a softmax gives the class. Vectors and output
are trained by stochastic gradient descent in numpy from a bounded sample of labelled rows.

Besides, two marks of the text as a whole have vectors of their own, which the averages of words
can't tell: its length, and the share of words that repeat the one before (MARKS turns them off).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold_of, hashed_words, labelled_sample, mix, small_batches, table, text_chunks

#: Labelled rows to train from, at most.
LEARN_ROWS = 4_000
#: Hash buckets, components, n-gram sizes in characters.
BUCKETS, DIMENSIONS, SHORTEST, LONGEST = 1 << 16, 8, 2, 4
#: Passes, step size, and seed.
EPOCHS, RATE, SEED = 8, 0.1, 31
#: Rows with this score or more are of quality.
THRESHOLD = 0.7

#: Whether texts have marks of their length and repetition.
MARKS = True
#: Buckets of the marks of a text: its length's binary digits, and words that follow their like.
_MARKS = 40
_REPEATED = 39


def features_of(column):
    """Yields (row, buckets, weights) for every text of an Arrow column.

    A word has a bucket for itself and for the n-grams of its characters between marks, which weigh
    alike, as words do. A text without words has the length mark alone.
    """
    for row, data, offsets in text_chunks(column):
        h, first, starts, ends = hashed_words(data, offsets, places=True)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        starts, ends = before[starts], before[ends]
        size = ends - starts
        at = np.r_[0, np.cumsum(size + 2)]
        marked = np.zeros(at[-1], np.uint64)
        marked[at[:-1]], marked[at[1:] - 1] = 1, 2
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        marked[np.repeat(at[:-1] + 1, size) + inner] = points[np.repeat(starts, size) + inner].astype(np.uint64) + np.uint64(3)
        word = np.repeat(np.arange(len(size)), size + 2)
        grams = 1 + sum((np.maximum(0, size + 2 - n + 1) for n in range(SHORTEST, LONGEST + 1)), np.zeros(len(size), np.int64))
        share = (1.0 / grams).astype(np.float32)
        buckets = [h]
        owners = [np.arange(len(size))]
        run = marked
        for n in range(2, LONGEST + 1):
            run = run[: len(run) - 1] * np.uint64(0x9E3779B97F4A7C15) + marked[n - 1 :]
            if n >= SHORTEST:
                whole = np.flatnonzero(word[: len(run)] == word[n - 1 :]) if len(run) else np.zeros(0, np.int64)
                buckets.append(mix(run[whole] + np.uint64(n)))
                owners.append(word[whole])
        keys = [(b % np.uint64(BUCKETS - _MARKS)).astype(np.int64) + _MARKS for b in buckets]
        same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
        for i in range(len(offsets) - 1):
            a, b = int(first[i]), int(first[i + 1])
            marks, held = ([min(_REPEATED - 1, int(b - a).bit_length())], [0.1]) if MARKS else ([], [])
            if MARKS and b - a > 1 and (n := int(same[a + 1 : b].sum())):
                marks.append(_REPEATED)
                held.append(n / (b - a))
            parts, weights = [np.array(marks, np.int64)], [np.array(held, np.float32)]
            for k, o in zip(keys, owners):
                lo, hi = np.searchsorted(o, (a, b))
                parts.append(k[lo:hi])
                weights.append(share[o[lo:hi]] / np.float32(max(1, b - a)))
            yield row + i, np.concatenate(parts), np.concatenate(weights)


class Model:
    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vectors, self.output, self.bias = vectors, output, bias

    def classes(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.output + self.bias
        z = np.exp(z - z.max())
        return z / z.sum()

    def probability(self, buckets: np.ndarray, weights: np.ndarray) -> float:
        """Of label 1."""
        return float(self.classes(weights @ self.vectors[buckets])[1])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    """Stochastic gradient descent, with steps that shrink for buckets that have moved much; both classes weigh alike.

    Each row has a bucket once. Without rows, all scores are 1/2.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    model = Model(vectors, rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32))
    y = np.array(labels, np.int64)
    if not len(y):
        model.output[:] = 0
        return model
    share = len(y) / (2.0 * np.maximum(np.bincount(y, minlength=2), 1))
    moved, out_moved = np.full(BUCKETS, 1e-12, np.float32), 1e-6
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(y)):
            buckets, weights = rows[i]
            hidden = weights @ vectors[buckets]
            error = model.classes(hidden)
            error[y[i]] -= 1.0
            error = (error * share[y[i]]).astype(np.float32)
            back = model.output @ error
            moved[buckets] += weights**2 * (back @ back)
            step = np.outer(hidden, error)
            out_moved += float((step**2).sum())
            vectors[buckets] -= np.outer(rate * weights / np.sqrt(moved[buckets]), back)
            model.output -= (rate / out_moved**0.5) * step
            model.bias -= 0.01 * rate * error
    return model


def learn_from(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that aren't held out (LEARN_ROWS of them, at most)."""
    small_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels.where(F.col("quality").isin(0, 1)), "quality", fold_of(F.col("doc_id"), 4) != 2, LEARN_ROWS)

    def run(batches):
        for batch in batches:
            rows = [_dense(b, w) for _, b, w in features_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in rows], pa.list_(pa.int32())), pa.array([w for _, w in rows], pa.list_(pa.float32())), batch.column(2)], ["doc_id", "buckets", "weights", "quality"])

    found = sample.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id long, buckets array<int>, weights array<float>, quality int")
    found = found.toArrow().sort_by([("doc_id", "ascending")])
    rows = []
    for chunk in found.select(["buckets", "weights"]).combine_chunks().to_batches():
        cuts = chunk.column(0).offsets.to_numpy()
        buckets, weights = (chunk.column(k).values.to_numpy() for k in (0, 1))
        rows += [(buckets[a:b], weights[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return train(rows, found["quality"].to_pylist())


def _dense(buckets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once, with the sum of its weights: BUCKETS entries at most, however long the text."""
    held = np.bincount(buckets, weights, BUCKETS)
    at = np.flatnonzero(held)
    return at.astype(np.int32), held[at].astype(np.float32)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Null and wordless texts score what the mark of their length gives; repeated rows are scored each; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.output, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.probability(b, w) for _, b, w in features_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_quality(documents, learn_from(documents, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": query}
ORACLE_SQL: dict[str, str] = {}
