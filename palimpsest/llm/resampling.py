"""Importance resampling towards a target distribution.

Words of the corpus and of the target are counted by hashed bucket; a bucket's gain is the scaled
logarithm of its smoothed odds. A document's weight is the sum of its features' gains, looked up in
an array, and its score the weight plus Gumbel noise from the hash of its id, so that the highest
scores are a draw without replacement by weight. The k-th highest key (score, id, size) is found by
distributed radix selection: histograms of the leading digits in which the remaining keys differ,
each over the keys that share all digits fixed before. Only what is drawn is range-sorted and ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import CHUNK_BYTES, cut, small_batches, table

#: Buckets of features, the words of a feature at most, the scale of gains and noise, the seed.
BUCKETS, LONGEST, SCALE, SEED = 10_000, 1, 1000, "2024"
#: Words that a document must have, and the percentage of such documents that is drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Bits of a digit; a histogram has at most 2 to that power rows.
DIGIT_BITS = 12
#: Repeats of a row that are written out by one row of a task.
REPEATS = 4096
#: Buckets of features that a worker keeps.
KEPT = 1 << 18

#: Lower case of A-Z, letters, digits and bytes of other characters as they are, a blank for all else.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LOW = -(1 << 63)


def features_of(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, list[bytes]]]:
    """Pieces of a text: how many words each has, and the runs of 1 to ``longest`` words that end in it."""
    plain, at, before = text.translate(_PLAIN), 0, []
    while at < len(plain):
        end = plain.find(b" ", min(at + CHUNK_BYTES, len(plain)))
        end = len(plain) if end < 0 else end
        words = plain[at:end].split(b" ")
        words = [w for w in words if w]
        at = end
        grams = list(words)
        held = before + words
        for n in range(2, longest + 1):
            grams += [b" ".join(held[k - n + 1 : k + 1]) for k in range(max(len(before), n - 1), len(held))]
        before = held[max(0, len(held) - longest + 1) :] if longest > 1 else []
        yield len(words), grams


class Buckets:
    """Counts of a text's features by bucket."""

    def __init__(self, size: int, longest: int):
        self.size, self.longest, self.known = size, longest, {}

    def counts(self, text: bytes | None) -> tuple[int, list[int], list[int]]:
        """Words, and buckets (repeats possible) with their counts."""
        n_words, buckets, numbers = 0, [], []
        for n, features in features_of(text or b"", self.longest):
            n_words += n
            for feature, number in Counter(features).items():
                bucket = self.known.get(feature)
                if bucket is None:
                    if len(self.known) >= KEPT:
                        self.known.clear()
                    bucket = self.known[feature] = zlib.crc32(feature) % self.size
                buckets.append(bucket)
                numbers.append(number)
        return n_words, buckets, numbers


def bucket_totals(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket: each task sends at most one row a bucket, and the driver gets as many."""
    small_batches(texts.sparkSession)

    def run(batches):
        held, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                _, where, numbers = held.counts(t)
                np.add.at(total, np.array(where, np.int64), np.array(numbers, np.int64))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln(odds of target to corpus)) of each bucket, each count one more than it is."""
    s, t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    odds = [(float(y + 1) * float(s + b)) / (float(x + 1) * float(t + b)) for x, y in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(scale * math.log(o)) for o in odds], np.int64)


def noise(doc_id: str | None, seed: str = SEED, scale: int = SCALE) -> int:
    """Gumbel noise from the first 32 bits of a hash of the id; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        held = Buckets(len(gain), longest)
        for batch in batches:
            sizes, features, weights, scores = [], [], [], []
            for t, name in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                n_words, where, numbers = held.counts(t)
                weight = int((gain[np.array(where, np.int64)] * np.array(numbers, np.int64)).sum())
                sizes.append(n_words)
                features.append(sum(numbers))
                weights.append(weight)
                scores.append(weight + noise(name, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (sizes, features, weights, scores)]], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("doc_id").cast("string").alias("name"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def kth_key(groups: DataFrame, keys: list[Column], copies: Column, place: Callable[[int], int]) -> tuple[int, list[int], int] | None:
    """The k-th smallest of composite keys of signed longs: k, that key, and how many rows with smaller keys there are.

    ``copies`` says how many rows a group stands for; of N rows, the k-th is looked for with
    k = ``place(N)`` (None where that is 0). A round counts the rows by the leading digit in which the
    keys left differ, and goes on with the digit that holds the k-th; digits that all share cost no round.
    """
    names = [f"k{i}" for i in range(len(keys))]
    frame = groups.select(*[k.alias(n) for k, n in zip(keys, names)], copies.alias("copies"))
    bounds = [f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]
    held = frame.agg(F.sum("copies").alias("n"), *bounds).first()
    k = place(held["n"] or 0)
    if not k:
        return None
    below, fixed = 0, F.lit(True)
    while True:
        spread = [(n, (held[f"min_{n}"] - _LOW) ^ (held[f"max_{n}"] - _LOW)) for n in names]
        differing = next(((n, x.bit_length()) for n, x in spread if x), None)
        if differing is None:
            return k, [held[f"min_{n}"] for n in names], below
        name, bits = differing
        shift = max(0, bits - DIGIT_BITS)
        # the digits above are the same in all keys left; flipping the sign bit makes the order unsigned
        digit = F.shiftrightunsigned(F.col(name).bitwiseXOR(F.lit(_LOW)), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        counts = frame.where(fixed).groupBy(digit.alias("digit")).agg(F.sum("copies").alias("n"), *bounds).collect()
        for r in sorted(counts, key=lambda r: r["digit"]):
            if below + r["n"] >= k:
                held, fixed = r, fixed & (digit == F.lit(r["digit"]))
                break
            below += r["n"]


def _not_after(keys: list[Column], key: list[int]) -> Column:
    """Whether a composite key is at most ``key``."""
    at_most = F.lit(True)
    for column, value in reversed(list(zip(keys, key))):
        at_most = (column < F.lit(value)) | ((column == F.lit(value)) & at_most)
    return at_most


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED
) -> DataFrame:
    """Every document with its weight, its score, and its rank among the drawn ones, null for the others.

    ``target`` has a column text. Of the N rows with ``least_words`` words, floor(percent * N / 100) are drawn: those
    of the highest scores, ties to the smaller doc_id, null last, then to fewer features. Rows that are alike in all of it are
    interchangeable and drawn one by one. Null texts have no words. An empty target has the same gain for
    buckets of the same count. Empty tables give no rows; other columns are left out. doc_id is a whole number.
    """
    gain = gains(bucket_totals(docs, "text", buckets, longest), bucket_totals(target, "text", buckets, longest))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    groups = cut(scored(docs, gain, longest, seed).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")))
    keys = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("n_features")]
    enough = F.col("n_words") >= least_words
    last = kth_key(groups.where(enough), keys, F.col("copies"), lambda n: percent * n // 100)
    if last is None:
        return _repeated(groups.withColumn("before", F.lit(None).cast("long")), 0)
    k, key, _ = last
    drawn = enough & _not_after(keys, key)
    ordered = groups.where(drawn).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    ordered = cut(ordered)
    sizes = sorted(ordered.groupBy("part").agg(F.sum("copies")).collect())
    starts = np.r_[0, np.cumsum([n for _, n in sizes])[:-1]].tolist()
    offsets = groups.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts)], "part int, start long")
    inner = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ordered.withColumn("inner", F.sum("copies").over(inner) - F.col("copies")).join(F.broadcast(offsets), "part")
    ranked = ranked.select(*columns, "copies", (F.col("start") + F.col("inner")).alias("before"))
    rest = groups.where(~drawn).select(*columns, "copies", F.lit(None).cast("long").alias("before"))
    return _repeated(ranked.unionByName(rest), k)


def _repeated(groups: DataFrame, k: int) -> DataFrame:
    """The rows that groups stand for, in blocks that are dealt anew, as one group may stand for many; ranks up to ``k``."""
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / REPEATS).cast("long"))))
    blocks = blocks.repartition("doc_id", "n_features", "block")
    last = F.least(F.col("copies") - F.col("block") * REPEATS, F.lit(REPEATS).cast("long"))
    rows = blocks.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    rank = F.col("before") + F.col("block") * REPEATS + F.col("j")
    return rows.select("doc_id", "n_features", "weight", "score", F.when(rank <= k, rank).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: A word's crc32 is taken over its bytes, from their hexadecimal digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
  lambda c, b: list_reduce(range(8)::BIGINT[], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

QUERIES = {"op13_resampling": query}
ORACLE_SQL = {
    "op13_resampling": f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
dw AS (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL),
vocabulary AS (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS (SELECT w, {_CRC} % {BUCKETS} AS bucket FROM vocabulary),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN hashed USING (w) GROUP BY 1),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gain AS (SELECT bucket, floor({SCALE} * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + {BUCKETS})) / ((coalesce(s.n, 0) + 1)::DOUBLE * (totals.t + {BUCKETS}))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), totals),
weights AS (SELECT row, sum(n * g) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN weights USING (row)),
drawn AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id, n_features) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) // 100 THEN place END AS rank FROM drawn"""
}
