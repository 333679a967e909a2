"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of a test item, however many items hold it, seeds matches in the documents; around
the seeds, the item is aligned with the document's words, so that edited and paraphrased copies score
as well. An alignment without three equal words in a row is not looked for. Test
items are a query set: they are broadcast in blocks of bounded size, and no document is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

#: Words in a seed; items of fewer words are one seed.
SEED_WORDS = 3
#: Alignment scores of equal words, unequal words and skipped words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document is contaminated if an item reaches this share of the score of a whole copy.
THRESHOLD = 0.6
#: Words of the items that are broadcast at once.
BLOCK_WORDS = 500_000

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the smallest place in the second past which an alignment of that score ends."""
    row = np.zeros(len(b) + 1, np.int64)
    gaps = GAP * np.arange(len(b) + 1)
    best, end = 0, 0
    for word in a.tolist():
        here = np.maximum(0, np.maximum(row[1:] + GAP, row[:-1] + np.where(b == word, MATCH, MISMATCH)))
        # A gap along the row: the best earlier cell less its distance.
        row = np.concatenate([[0], here])
        row = np.maximum.accumulate(row - gaps) + gaps
        k = int(np.argmax(row))
        if row[k] > best or (row[k] == best and k < end):
            best, end = int(row[k]), k
    return best, end


def passage(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best score of ``a`` in ``b``, and start and end in ``b`` of the first, then shortest, passage that has it."""
    score, end = alignment(a, b)
    # No alignment of this score ends before ``end``, so that backwards from there each begins at it.
    _, back = alignment(a[::-1], b[:end][::-1])
    return score, end - back, end


class Items:
    """Test items, their words as numbers, and the seeds that lead to them; items of equal words are one."""

    def __init__(self, items: list[tuple[int, str]]):
        self.numbers: dict[str, int] = {}
        same: dict[tuple, list[int]] = {}
        for i, t in items:
            same.setdefault(tuple(self.numbers.setdefault(w, len(self.numbers)) for w in tokens(t)), []).append(i)
        same.pop((), None)
        self.ids = list(same.values())
        self.words = [np.array(w, np.int64) for w in same]
        #: By length of seeds: their keys in order, where each one's holders start, the holders, and each holder's seeds.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]] = {}
        for n in range(1, SEED_WORDS + 1):
            own = {k: np.unique(self._keys(w, n)) for k, w in enumerate(self.words) if min(SEED_WORDS, len(w)) == n}
            if own:
                keys, seed = np.unique(np.concatenate(list(own.values())), return_inverse=True)
                holder = np.repeat(np.array(list(own), np.int64), [len(s) for s in own.values()])
                order = np.argsort(seed, kind="stable")
                starts = np.searchsorted(seed[order], np.arange(len(keys) + 1))
                self.seeds[n] = keys, starts, holder[order], {k: np.searchsorted(keys, s) for k, s in own.items()}

    def _keys(self, words: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n words, -1 where a word is in no item; BLOCK_WORDS words make no equal ones."""
        out = words[: max(0, len(words) - n + 1)].copy()
        unknown = out < 0
        for j in range(1, n):
            word = words[j : j + len(out)]
            out = out * len(self.numbers) + word
            unknown |= word < 0
        out[unknown] = -1
        return out

    def matches(self, text: str | None) -> Iterator[tuple[int, float, int, int]]:
        """(item, score, start, end) of every item found, at its best place, in words of the text.

        All items that share a seed with the text are looked at. An item is only left unaligned where
        too few of its words are there for the score.
        """
        line = np.array([self.numbers.get(w, -1) for w in tokens(text)], np.int64)
        there = np.zeros(len(self.numbers) + 1, bool)
        there[line] = True
        there[-1] = False
        for n, (keys, starts, holders, own) in self.seeds.items():
            here = self._keys(line, n)
            seed = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
            at = np.flatnonzero(keys[seed] == here)
            if not len(at):
                continue
            seed = seed[at]
            near = np.unique(np.concatenate([holders[starts[s] : starts[s + 1]] for s in np.unique(seed).tolist()]))
            for k in near.tolist():
                words = self.words[k]
                least = THRESHOLD * MATCH * len(words)
                if MATCH * int(there[words].sum()) < least:
                    continue
                held = np.zeros(len(keys), bool)
                held[own[k]] = True
                score, start, end = self._best(words, line, at[held[seed]], least)
                if score >= least:
                    for i in self.ids[k]:
                        yield i, score / (MATCH * len(words)), start, end

    def _best(self, words: np.ndarray, line: np.ndarray, places: np.ndarray, least: float) -> tuple[int, int, int]:
        """Score, start and end of the best alignment around the places, if it reaches ``least``."""
        size, best = len(words), (0, 0, 0)
        mine = np.zeros(len(self.numbers) + 1, bool)
        mine[words] = True
        for group in np.split(places, np.flatnonzero(np.diff(places) > 2 * size) + 1):
            lo, hi = max(0, int(group[0]) - 2 * size), min(len(line), int(group[-1]) + 2 * size)
            # A score of the threshold takes under 2 * size words of the text, of which so many are the item's.
            known = np.r_[0, np.cumsum(mine[line[lo:hi]])]
            if MATCH * int((known[min(2 * size, hi - lo) :] - known[: max(1, len(known) - 2 * size)]).max()) < least:
                continue
            score, end = alignment(words, line[lo:hi])
            if score > best[0]:
                best = score, lo, lo + end
        if best[0] >= least:
            score, lo, end = best
            # such a score takes under 2 * size words
            lo = max(lo, end - 2 * size)
            best = score, lo + passage(words, line[lo:end])[1], end
        return best


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    blocks, block, held = [], [], 0
    for item, text in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((item, text))
        held += len(tokens(text))
        if held >= BLOCK_WORDS:
            blocks.append(block)
            block, held = [], 0
    return blocks + ([block] if block else [])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score (share of a whole copy's alignment score), start and end (words of the document).

    A row for each document and test item found in it; its place is that of the first passage with the best score,
    of those that end there the shortest. Null or wordless texts and items find
    nothing; repeated rows are each answered; items with equal texts are all reported; other columns are ignored;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, score double, start long, end long"
    found = spark.createDataFrame([], schema)
    names = ["doc_id", "item_id", "score", "start", "end"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            known = Items(shared.value)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in known.matches(t)]
                columns = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        found = found.union(one)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All columns of the documents in which no test item is found; rows of null doc_id are judged by their own texts."""
    spark = docs.sparkSession
    small_batches(spark)
    clean = docs
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            known = Items(shared.value)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                yield batch.filter(pa.array([next(known.matches(t), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        clean = clean.mapInArrow(run, clean.schema)
    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": query}
ORACLE_SQL: dict[str, str] = {}
