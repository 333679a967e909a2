"""Tables of known terms and aliases that answer before anything is computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: A term's row: what it is, how sure, since when, and how often it answered.
TERMS = "term string, normalized string, domain string, type string, label string, confidence double, created_at timestamp, hit_count long"
KEY = ["domain", "normalized"]


def lookup(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked rows (domain, normalized) with ``hit`` and the cached term, type, label and confidence."""
    held = cache.select(*KEY, "term", "type", "label", "confidence", F.lit(True).alias("hit"))
    return asked.join(held, KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hits(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """The cache with the hits of the asked rows added."""
    n = asked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("asked_n"))
    joined = cache.join(n, KEY, "left")
    return joined.withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("asked_n", F.lit(0))).select(*cache.columns)


def stats(found: DataFrame) -> DataFrame:
    """Hits, misses and the share of hits of a lookup; the share of none is 0."""
    n, hit = F.count(F.lit(1)), F.count(F.when(F.col("hit"), 1))
    return found.agg(hit.alias("hits"), (n - hit).alias("misses"), F.coalesce(F.try_divide(hit, n), F.lit(0.0)).alias("rate"))


def domain_stats(cache: DataFrame) -> DataFrame:
    """(D8)"""
    return cache.groupBy("domain").agg(F.count(F.lit(1)).alias("terms"))


def extracted(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """Cached terms as if extracted: from the whitelist, with a score of ten times their confidence and no frequency."""
    held = lookup(cache, asked).where("hit")
    return held.select(
        "term", "normalized", F.concat_ws(".", "domain", "normalized").alias("namespace"), "domain", "type", "label", F.lit("whitelist").alias("source"),
        "confidence", F.lit(0).cast("long").alias("freq"), (F.col("confidence") * 10).alias("score"), F.lit("UPPER").alias("case_pattern"),
    )


def put(cache: DataFrame, rows: DataFrame, most: int = 10_000) -> DataFrame:
    """The cache with the rows, the latest of a key; of more than ``most`` the oldest go.

    Rows of one time and key: the surest stays.
    """
    both = cache.unionByName(rows)
    latest = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("created_at"), F.desc("confidence"), "term")
    one = both.withColumn("place", F.row_number().over(latest)).where("place = 1").drop("place")
    return one.orderBy(F.desc_nulls_last("created_at"), *KEY).limit(most)


def seeds(terms: DataFrame, domain: str, at) -> DataFrame:
    """Rows (term, type) as seed terms of a domain, which are wholly sure."""
    return terms.select(
        "term", F.lower("term").alias("normalized"), F.lit(domain).alias("domain"), "type", F.concat(F.lit("T/"), F.col("type")).alias("label"),
        F.lit(1.0).alias("confidence"), at.alias("created_at"), F.lit(0).cast("long").alias("hit_count"),
    )


def promoted(cache: DataFrame, terms: DataFrame, confidence: float = 0.95, freq: int = 50) -> DataFrame:
    """Extracted terms (term, normalized, domain, type, label, confidence, freq) that become seeds.

    They are sure and frequent, of a domain, and no seed yet; of several rows of a key the surest, then most frequent.
    """
    due = terms.where((F.col("confidence") >= confidence) & (F.col("freq") >= freq) & (F.col("domain") != "general"))
    new = due.join(seed_terms(cache).select(*KEY), KEY, "left_anti")
    first = F.max_by(F.struct("term", "type", "label"), F.struct("confidence", "freq", "term"))
    return new.groupBy(*KEY).agg(first.alias("t")).select("t.term", "normalized", "domain", "t.type", "t.label", F.lit(1.0).alias("confidence"))


def seed_terms(cache: DataFrame) -> DataFrame:
    """(J31)"""
    return cache.where((F.col("confidence") >= 1.0) & (F.col("domain") != "general"))


def write_json(cache: DataFrame, folder: str) -> None:
    """(A38)"""
    cache.write.mode("overwrite").json(folder)


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """(A39)"""
    return spark.read.schema(TERMS).json(folder)


def warm_aliases(aliases: DataFrame, most: int = 10_000, everything: bool = False) -> DataFrame:
    """The aliases to hold ready: all, or those verified or made by hand, ``most`` of them by time."""
    if everything:
        return aliases
    sure = aliases.where(F.col("verified") | (F.col("source") == "manual"))
    return sure.orderBy(F.desc_nulls_last("created_at"), "alias").limit(most)


def evict(aliases: DataFrame, most: int) -> DataFrame:
    """The ``most`` aliases used last."""
    return aliases.orderBy(F.desc_nulls_last("last_accessed"), "alias").limit(most)
