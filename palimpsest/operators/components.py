"""Connected components, and what is merged by them: synonyms and clusters without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import similar
from .checkpoints import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): the smallest node that it is connected to.

    Each round links every node to the smallest of its neighbours, first those beyond it, then those before it
    (large and small stars), until no link changes; the rounds grow with the logarithm of the longest path. A node of very many
    links is one row of an aggregate, and its links are dealt by both ends. Loops and null ends are no edges, but a node that only has a loop is its own root.
    """
    u, v = F.col("u"), F.col("v")
    own = cut(edges.where(u.isNotNull() & v.isNotNull()).select("u", "v").distinct())
    nodes = own.select(u.alias("node")).union(own.select(v)).distinct()
    links = cut(own.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    while True:
        before = _sum(links)
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where(u != v).distinct()
        links = cut(small)
        if _sum(links) == before:
            break
    roots = links.groupBy(u.alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _sum(links: DataFrame):
    """What tells two sets of links apart."""
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def synonym_classes(relations: DataFrame, terms: DataFrame, least: float = 0.99) -> DataFrame:
    """Every term (id, name, frequency) with the primary of its class, and what a primary holds.

    Terms that a chain of synonym relations of more than ``least`` connects are one class; its most frequent term is primary, of
    equally frequent ones the first. A primary has the class's frequency and the others' names as aliases, any other its own and none.
    """
    chain = relations.where((F.col("type") == "synonym") & (F.col("weight") > least)).select(F.col("in").alias("u"), F.col("out").alias("v"))
    roots = components(chain.join(terms.select(F.col("id").alias("u")), "u", "left_semi").join(terms.select(F.col("id").alias("v")), "v", "left_semi"))
    held = terms.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = held.groupBy("root").agg(F.min_by("id", F.struct(-F.col("frequency"), "id")).alias("primary_id"), F.sum("frequency").alias("total"), F.array_sort(F.collect_set("name")).alias("names"))
    first = F.col("id") == F.col("primary_id")
    return held.join(classes, "root").select(
        "id", "name", "primary_id", first.alias("is_primary"), F.when(first, F.col("total")).otherwise(F.col("frequency")).alias("frequency"),
        F.when(first, F.array_remove("names", F.col("name"))).otherwise(F.array().cast("array<string>")).alias("aliases"),
    )


def similar_clusters(memories: DataFrame, near: float = 0.9, least: int = 2) -> DataFrame:
    """(cluster, memory) of the memories (id, embedding) that chains of cosines of ``near`` or more connect, ``least`` in each, by its smallest id."""
    roots = components(similar.links(memories, near).select(F.col("a").alias("u"), F.col("b").alias("v")))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return roots.join(sizes, "root").select(F.col("root").alias("cluster"), F.col("node").alias("memory"))
