"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vectors of three letters in a row are permuted
by place and bound by multiplication; a text's vector is the bundle (sum) of its n-gram vectors. A
language's prototype is the bundle of its learned texts. A text has the language whose prototype
has the largest cosine with its vector.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold_of, labelled_sample, small_batches, table

#: Components of a vector, letters in an n-gram, and the seed of the letters' vectors.
DIMENSIONS, GRAM, SEED = 1024, 3, 2718
#: Distinct symbols: the blank, and letters by code point modulo one less than this.
SYMBOLS = 512
#: Labelled rows from which prototypes are learned, at most.
LEARN_ROWS = 20_000
#: n-gram vectors that a worker keeps.
KEPT = 16_384

_symbols = np.full(0x110000, -1, np.int16)


def _symbol_of(points: np.ndarray) -> np.ndarray:
    found = _symbols[points]
    if (found < 0).any():
        for point in np.unique(points[found < 0]).tolist():
            char = chr(point)
            if not char.isalpha():
                _symbols[point] = 0
            else:
                low = char.lower()[:1]
                _symbols[point] = 1 + ord(unicodedata.normalize("NFC", low)[:1]) % (SYMBOLS - 1)
        found = _symbols[points]
    return found


def grams_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-gram ids and their counts; none without a letter. Runs of other characters are one blank."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = _symbol_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.int64)
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.r_[0, s, 0]
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    ids = np.zeros(len(s) - GRAM + 1, np.int64)
    for k in range(GRAM):
        ids = ids * SYMBOLS + s[k : k + len(ids)]
    return np.unique(ids, return_counts=True)


class Space:
    """The vectors of n-grams, made as they are needed."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.ids: dict[int, int] = {}
        self.rows = np.zeros((256, dimensions), np.float32)

    def bind(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones((len(ids), self.letters.shape[1]), np.int8)
        for k in range(GRAM):
            out *= np.roll(self.letters[ids % SYMBOLS], k, axis=1)
            ids = ids // SYMBOLS
        return out.astype(np.float32)

    def bundle(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        new = [i for i in ids.tolist() if i not in self.ids]
        if len(self.ids) + len(new) > KEPT:
            self.ids.clear()
            new = ids.tolist()
        if len(new) > KEPT:
            parts = range(0, len(ids), KEPT)
            return sum((counts[p : p + KEPT].astype(np.float32) @ self.bind(ids[p : p + KEPT]) for p in parts), np.zeros(self.letters.shape[1], np.float32))
        if new:
            used = len(self.ids)
            if used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(new), len(self.rows)), self.rows.shape[1]), np.float32)])
            self.rows[used : used + len(new)] = self.bind(np.array(new, np.int64))
            self.ids.update(zip(new, range(used, used + len(new))))
        at = np.fromiter(map(self.ids.__getitem__, ids.tolist()), np.int64, len(ids))
        return counts.astype(np.float32) @ self.rows[at]


def learn_prototypes(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from rows (text, lang).

    Bundling is a sum, so the rows' n-grams are counted by language first.
    """

    def count(batches):
        for batch in batches:
            langs, ids, counts = [], [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i, c = grams_of(text)
                langs += [lang] * len(i)
                ids.append(i)
                counts.append(c)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(ids or [none])), pa.array(np.concatenate(counts or [none]))], ["lang", "gram", "n"])

    grams = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs, space = sorted(grams["lang"].unique()), Space()
    vectors = []
    for lang in langs:
        own = grams[grams["lang"] == lang].sort_values("gram")
        v = np.zeros(DIMENSIONS)
        for p in range(0, len(own), 4096):
            v += own["n"].to_numpy()[p : p + 4096].astype(np.float64) @ space.bind(own["gram"].to_numpy()[p : p + 4096])
        vectors.append(v / max(np.linalg.norm(v), 1e-12))
    return langs, np.array(vectors).reshape(len(langs), DIMENSIONS)


def learn_from(documents: DataFrame) -> tuple:
    """Prototypes from the documents with a language that aren't held out (LEARN_ROWS of them, at most)."""
    small_batches(documents.sparkSession)
    keep = (fold_of(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    langs = documents.select("doc_id", "lang")
    return learn_prototypes(labelled_sample(documents, langs, "lang", keep, LEARN_ROWS))


def identify_language(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 if negative) of every row.

    Texts that are null, empty or without a letter are ``und`` with score 0, as are all under a
    model without languages; ties go to the language first in order. Repeated rows are each
    answered, other columns are ignored, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, prototypes = shared.value
        space = Space()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                ids, counts = grams_of(text)
                name, score = "und", 0.0
                if len(ids) and langs:
                    v = space.bundle(ids, counts)
                    cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(np.argmax(cosines))
                    name, score = langs[best], float(min(1.0, max(0.0, cosines[best])))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify_language(documents, learn_from(documents))
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": query}
ORACLE_SQL: dict[str, str] = {}
