"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Documents get a random key from the hash of their id. Each source is range-split by its key into
``BUCKETS`` equal ranges, whose token totals are summed over the ranges below (a few rows for a
source, whatever its size); within a range a running sum gives each document its place. The last
epoch of a source is cut where its budget ends. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD_PATTERN, cut, table

#: Ranges of the random key in each source, by three hexadecimal digits of its hash.
BUCKETS = 4096
#: Sources whose totals are ranked and broadcast; more are refused rather than handled badly.
MAX_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds weight and target to rows (source, source_size).

    Targets are min(level * weight, most * size), with the level at which they add up to ``share``
    of all sizes. The sum is a concave function of the level, so that the level is the largest of
    (total - limits of the sources below) / (weights of the others) over the sources ordered by limit per weight.
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(rank) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    limit = F.col("source_size") * F.lit(float(most))
    sized = totals.withColumn("weight", weight).withColumn("limit", limit)
    line = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    below = F.coalesce(F.sum("limit").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    sized = sized.withColumn("level", (total - below) / above)
    sized = sized.withColumn("level", F.max("level").over(everything))
    return sized.select("source", "source_size", "weight", F.least(F.col("level") * F.col("weight"), F.col("limit")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words that a mixture takes of each document.

    Sources, ordered by code point with null last, weigh ``weights`` in turn and share ``share``
    times all words; no source is taken more than ``most`` times over. A source is repeated whole
    while its budget lasts, and cut to the word in the last epoch; the order within a source is
    that of the md5 of doc_id, so reruns agree. Returns doc_id, source, size, source_size, target
    and taken for every row. Null texts have size 0; null doc_ids come last in their source; rows
    that are alike are separate documents; extra columns are ignored; an empty table gives no rows.
    """
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("~"))
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key"), F.md5("text").alias("tie"))
    sized = sized.withColumn("bucket", F.substring("key", 1, 3))
    sized = cut(sized)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = cut(source_targets(totals, weights, share, most))
    if (sources := targets.count()) > MAX_SOURCES:
        raise ValueError(f"{sources} sources; at most {MAX_SOURCES} can be weighed")

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    goal = targets.select(F.col("source").alias("s"), "source_size", "target")
    buckets = buckets.join(F.broadcast(goal), F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket_size")

    a, b = sized.alias("a"), buckets.alias("b")
    placed = a.join(b, (same(sized, buckets)) & (F.col("a.bucket") == F.col("b.bucket")))
    placed = placed.select("a.*", "b.before", "b.source_size", "b.target")
    run = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", F.col("tie").asc_nulls_last())
    start = F.col("before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    last = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last - start))
    return placed.withColumn("taken", taken.cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_MIX = r"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '~') AS key, md5(text) AS tie
  FROM docs),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM totals),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM weighed),
targets AS (SELECT source, source_size, least(max(own) OVER () * weight, lim) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.tie NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""
ORACLE_TAKEN = """CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
  + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE budget END - start)) AS BIGINT) AS taken"""

QUERIES = {"op1_mix_sources": query}
ORACLE_SQL = {"op1_mix_sources": f"WITH docs AS (SELECT * FROM documents), {ORACLE_MIX} SELECT doc_id, size, source_size, target, {ORACLE_TAKEN} FROM placed"}
