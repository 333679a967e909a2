"""Full-text ranking by BM25: postings with counts, document lengths, inverse frequencies."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import search as R
from .checkpoints import cut, spread

#: How soon a word's count saturates, and how far a document's length counts.
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """(id, word, n, size): how often each word stands in each document (id, text), and the document's words; counted before anything is shuffled by word."""
    own = docs.select("id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    counted = own.select("id", F.size("w").alias("size"), F.explode("w").alias("word"))
    return counted.groupBy("id", "size", "word").agg(F.count(F.lit(1)).alias("n")).select("id", "word", "n", F.col("size").cast("long").alias("size"))


def bm25(docs: DataFrame, query: str, k: int = 10, held: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score): the ``k`` documents that rank highest for the query's words, ties by id.

    Without ``held`` postings the texts are scanned once, and only the query's words are counted, where the text is; with
    them (kept by word) only the rows of the query's words are read. A repeated word of the query counts once.
    """
    asked = sorted(set(query_words(query)))
    if not asked:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    if held is None:
        all_words = words(F.col("text"))
        sized = spread(docs.select("id", "text")).select("id", all_words.alias("w")).select("id", F.size("w").cast("long").alias("size"), *[_count("w", a).alias(f"n{i}") for i, a in enumerate(asked)])
        sized = cut(sized)  # a few numbers a document, so that the texts are read once
        total = sized.agg(F.count(F.when(F.col("size") > 0, 1)).alias("docs"), F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(1.0)).alias("mean"), *[F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"d{i}") for i in range(len(asked))]).first()
        weights = [_idf(total["docs"], total[f"d{i}"]) for i in range(len(asked))]
        score = sum((F.lit(weights[i]) * _saturated(F.col(f"n{i}"), F.col("size"), total["mean"], k1, b) for i in range(len(asked))), F.lit(0.0))
        found = sized.where(" OR ".join(f"n{i} > 0" for i in range(len(asked)))).select("id", score.alias("score"))
    else:
        total = docs.select(F.size(words(F.col("text"))).alias("size")).where("size > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("size").alias("mean")).first()
        own = held.where(F.col("word").isin(*asked))
        weights = {r["word"]: _idf(total["docs"], r["d"]) for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("d")).collect()}  # a row a word of the query
        weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("word")] if weights else F.lit(0.0)
        found = own.groupBy("id").agg(F.sum(weight * _saturated(F.col("n"), F.col("size"), total["mean"] or 1.0, k1, b)).alias("score"))
    return found.orderBy(F.desc(F.round("score", 9)), F.asc("id")).limit(k)


def _count(words_: str, word: str) -> Column:
    return F.size(F.filter(words_, lambda x: x == word)).cast("long")


def query_words(query: str) -> list[str]:
    return re.findall("[a-z0-9_]+", query.lower())


def _idf(docs: int, holding: int) -> float:
    return math.log(1 + (docs - holding + 0.5) / (holding + 0.5))


def _saturated(n: Column, size: Column, mean: float, k1: float, b: float) -> Column:
    return n * (k1 + 1) / (n + k1 * (1 - b + b * size / F.lit(float(mean))))


def hybrid_bm25(memories: DataFrame, query: str, vector: list[float], k: int = 10, weight: float = 0.5, candidates: int = 100) -> DataFrame:
    """(id, score, bm25, similarity): the best of what either path finds, by a mean of similarity and of BM25 over its largest score."""
    said = bm25(memories.select("id", F.col("content").alias("text")), query, candidates)
    close = R.vector_search(memories, vector, candidates).select("id", "similarity")
    both = said.select("id", F.col("score").alias("bm25")).join(close, "id", "full_outer")
    ids = both.select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    rows = R.similar(memories.select("id", "embedding").join(F.broadcast(ids), "id"), vector)  # two times ``candidates`` rows at most
    best = F.max("bm25").over(Window.partitionBy())
    scaled = rows.withColumn("score", (1 - weight) * F.col("similarity") + weight * F.coalesce(F.try_divide(F.col("bm25"), best), F.lit(0.0)))
    return R.top(scaled.select("id", "score", "bm25", "similarity"), k, F.desc("score"), F.asc("id"))
