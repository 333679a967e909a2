"""Tables laid out by key: buckets that joins and look-ups use as they are, sorted, with Bloom filters (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a table; a multiple of the executors' cores, chosen once, as tables join without a shuffle only if it is the same.
BUCKETS = 16


def save_by_key(rows: DataFrame, table: str, key: str, *sort: str, buckets: int = BUCKETS, path: str | None = None, mode: str = "overwrite") -> None:
    """Saves rows as a table of the catalogue, a file for each bucket of ``key``, sorted by it and ``sort``.

    A look-up by the key reads one bucket, and in it only the row groups whose Bloom filter and
    statistics allow the value; tables of one key and number of buckets join, and are patched, without a shuffle. ``path`` is
    where the files lie, the warehouse by default.
    """
    writer = rows.repartition(buckets, key).write.format("parquet").mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer = writer.option("path", path) if path else writer
    writer.bucketBy(buckets, key).sortBy(key, *sort).saveAsTable(table)


def by_key(spark: SparkSession, table: str) -> DataFrame:
    """The table, as it is laid out."""
    return spark.table(table)
