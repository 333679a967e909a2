"""Retrieval: vector and graph search, merging, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.answers import ranking
from ..functions.scores import cosine
from ..functions.texts import jaccard, words_over_three
from ..sources.models import Model, complete

#: A merged path's score counts by this much.
PRIORITY = {"vector": 1.0, "graph": 1.0, "topic": 0.7}


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """A partial sort on each task and one of k rows each after it."""
    return df.orderBy(*order).limit(k)


def top_by(df: DataFrame, k: Column | int, by: str, *order: Column) -> DataFrame:
    """The first k rows of each group; ranks beyond k are dropped before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def similar(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("similarity", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, threshold: float | None = None) -> DataFrame:
    """Nearest rows by cosine (C22, F1); with a threshold, of the 2k nearest those above it, k at most."""
    found = similar(vectors, query)
    if threshold is None:
        return top(found, k, F.desc("similarity"), F.asc("id"))
    near = top(found, 2 * k, F.desc("similarity"), F.asc("id"))
    return top(near.where(F.col("similarity") > threshold), k, F.desc("similarity"), F.asc("id"))


def by_score(memories: DataFrame, score: Column, historical: bool = False) -> DataFrame:
    """The rows of the highest scores, to nine digits: three, or ten for a question about the past."""
    return top(memories.withColumn("score", F.round(score, 9)), 10 if historical else 3, F.desc("score"), F.asc("id"))


def typed_search(vectors: DataFrame, query: list[float], limits: dict) -> DataFrame:
    """The nearest rows of each type, as many as the type's limit."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("type")]
    found = similar(vectors.where(F.col("type").isin(*limits)), query)
    return top_by(found, limit, "type", F.desc("similarity"), F.asc("id"))


def keyword_vector_search(memories: DataFrame, query: list[float], words: str, k: int = 10, weight: float = 0.5) -> DataFrame:
    """Rows that contain the words, by a mean of similarity and a constant for the match."""
    held = memories.where(F.contains(F.lower("content"), F.lit(words.lower())))
    scored = similar(held, query).withColumn("score", (1 - weight) * F.col("similarity") + weight * 0.5)
    return top(scored, k, F.desc("score"), F.asc("id"))


def search_by_entity(edges: DataFrame, memories: DataFrame, entity, k: int = 10) -> DataFrame:
    """The heaviest edges of an entity with their memories (C1); the few edges are picked before the join."""
    own = top(edges.where(F.col("entity") == entity), k, F.desc("weight"), F.asc("memory"))
    return own.join(memories, own["memory"] == memories["id"], "left").drop("id")


def search_by_association(edges: DataFrame, seed, k: int = 10) -> DataFrame:
    """Edges of other memories to the entities of a memory."""
    mine = edges.where(F.col("memory") == seed).select("entity").distinct()
    return top(edges.where(F.col("memory") != seed).join(mine, "entity", "left_semi"), k, F.desc("weight"), F.asc("memory"), F.asc("entity"))


def multi_degree_search(edges: DataFrame, relations: DataFrame, seed, degree: int = 2, least: float = 0.1, k: int = 20) -> DataFrame:
    """Memories that share an entity with a memory, or from degree 2 on one that its entities lead to, by greatest weight."""
    mine = edges.where(F.col("memory") == seed).select("entity").distinct()
    reach = mine
    if degree >= 2:
        reach = relations.where(F.col("weight") >= least).join(mine, F.col("in") == F.col("entity"), "left_semi").select(F.col("out").alias("entity")).distinct()
    found = edges.where(F.col("memory") != seed).join(reach, "entity", "left_semi")
    return top(found.groupBy("memory").agg(F.max("weight").alias("weight")), k, F.desc("weight"), F.asc("memory"))


def graph_search(edges: DataFrame, entities: list, k: int = 20) -> DataFrame:
    """The heaviest edges of each entity, a memory once with its greatest weight (C4)."""
    own = top_by(edges.where(F.col("entity").isin(*entities)), k, "entity", F.desc("weight"), F.asc("memory"))
    return own.groupBy("memory").agg(F.max("weight").alias("weight"))


def topic_search(topics: DataFrame, links: DataFrame, parents: list, k: int = 10) -> DataFrame:
    """The heaviest memories of each topic under the entities, a memory once under its first topic."""
    chosen = topics.where(F.col("parent").isin(*parents)).select("topic", "created_at")
    own = top_by(links.join(chosen, "topic"), k, "topic", F.desc("weight"), F.asc("memory"))
    first = F.min_by(F.struct("topic", "weight"), F.struct(-F.unix_micros("created_at"), -F.col("weight"), F.col("topic")))
    return own.groupBy("memory").agg(first.alias("f")).select("memory", "f.topic", "f.weight")


def merge_two(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """Rows (id, score) of either path; the greater score, marked hybrid where both have it."""
    v, g = vector.select("id", F.col("score").alias("v")), graph.select("id", F.col("score").alias("g"))
    source = F.when(F.col("v").isNull(), "graph").when(F.col("g").isNull(), "vector").otherwise("hybrid")
    return v.join(g, "id", "full_outer").select("id", F.greatest("v", "g").alias("score"), source.alias("source"))


def merge_three(vector: DataFrame, graph: DataFrame, topic: DataFrame) -> DataFrame:
    """Three paths in order.

    The first path's score times its priority starts a row. A later path's score over its priority
    replaces the row's if it is greater than the row's over its source's priority, and is then
    taken as it is; a replaced row is hybrid, whose priority leaves nothing greater.
    """
    sides = [d.select("id", F.col("score").alias(n)) for d, n in ((vector, "v"), (graph, "g"), (topic, "t"))]
    joined = sides[0].join(sides[1], "id", "full_outer").join(sides[2], "id", "full_outer")
    v, g, t, p = F.col("v"), F.col("g"), F.col("t"), PRIORITY["topic"]
    two = v.isNotNull() & g.isNotNull() & (g > v)
    base = F.when(two, g).otherwise(F.coalesce(v, g))
    late = base.isNotNull() & t.isNotNull() & ~two & (t / p > base)
    score = F.when(late, t).otherwise(F.coalesce(base, t * p))
    source = F.when(two | late, "hybrid").when(v.isNotNull(), "vector").when(g.isNotNull(), "graph").otherwise("topic")
    return joined.select("id", score.alias("score"), source.alias("source"))


def said_order(results: DataFrame, query: str, model: Model, first: int = 30) -> DataFrame:
    """(id, place): the first rows (id, content, score) in the order that a model gives of their numbers; those it doesn't name follow by score."""
    head = top(results, first, F.desc("score"), F.asc("id")).select("id", "content", "score")
    ranked = head.withColumn("at", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)
    line = F.concat(F.lit("["), F.col("at"), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, 200))
    listed = F.array_sort(F.collect_list(F.struct("at", line.alias("line"), "id")))
    prompts = ranked.agg(listed.alias("rows")).where(F.size("rows") > 0).select(F.lit(0).alias("key"), F.transform("rows", lambda r: r["id"]).alias("ids"), F.concat(F.lit(f"Order by relevance to: {query}\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("prompt"))
    answers = complete(prompts, "key", "prompt", model)
    named = prompts.join(answers, "key").select("ids", F.posexplode(ranking(F.col("answer"), first)).alias("place", "at"))
    found = named.select(F.get("ids", F.col("at").cast("int")).alias("id"), "place").where("id IS NOT NULL")
    return found.groupBy("id").agg(F.min("place").alias("place"))


def rerank(results: DataFrame, first: int = 30, step: float = 0.05, penalty: float = 0.15, alike: float = 0.5, cluster_penalty: float = 0.2, order: DataFrame | None = None) -> DataFrame:
    """The first rows by score, or by ``order`` (id, place), given scores by rank, less penalties for what stands above.

    A row loses ``penalty`` for each of the first five rows above it that is alike, and
    ``cluster_penalty`` if a row above is of its cluster. The pairs are of ``first`` rows only.
    """
    head = top(results, first, F.desc("score"), F.asc("id"))
    by = [F.desc("score"), F.asc("id")]
    if order is not None:
        head, by = head.join(F.broadcast(order.select("id", "place")), "id", "left"), [F.asc_nulls_last("place"), *by]
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(*by)) - 1)
    ranked = ranked.withColumn("score", 1.0 - step * F.col("rank")).withColumn("words", words_over_three(F.col("content")))
    seen = F.row_number().over(Window.partitionBy("cluster").orderBy("rank")) > 1
    ranked = ranked.withColumn("repeated", F.col("cluster").isNotNull() & seen)
    above = ranked.where("rank < 5").select(F.col("rank").alias("r"), F.col("words").alias("w"))
    pairs = ranked.join(F.broadcast(above), F.col("r") < F.col("rank"), "left")
    alike_count = F.sum(F.when(jaccard(F.col("words"), F.col("w")) > alike, 1).otherwise(0))
    out = pairs.groupBy("id", "rank", "score", "repeated").agg(alike_count.alias("alike"))
    lost = penalty * F.col("alike") + F.when(F.col("repeated"), cluster_penalty).otherwise(0.0)
    return out.select("id", F.greatest(F.lit(0.0), F.col("score") - lost).alias("score"), "rank")


def retrieve(vectors: DataFrame, edges: DataFrame, links: DataFrame, topics: DataFrame, contents: DataFrame, query: list[float], text: str, entities: list, parents: list, k: int = 5, threshold: float = 0.6, model: Model | None = None) -> DataFrame:
    """Vector, graph and topic paths merged, reranked, cut by the threshold and to k rows (C21); a model may say the order."""
    short = len(text) < 10
    found = vector_search(vectors, query, k if short else max(4 * k, 20)).select("id", F.col("similarity").alias("score"))
    graph = graph_search(edges, entities).select(F.col("memory").alias("id"), F.col("weight").alias("score"))
    topic = topic_search(topics, links, parents).select(F.col("memory").alias("id"), F.col("weight").alias("score"))
    merged = F.broadcast(top(merge_three(found, graph, topic), 30, F.desc("score"), F.asc("id")))
    told = contents.select("id", "content").join(merged, "id").withColumn("cluster", F.lit(None).cast("string"))
    ranked = rerank(told, order=said_order(told, text, model) if model else None)
    return top(ranked.where(F.col("score") >= (max(threshold, 0.85) if short else threshold)), k, F.desc("score"), F.asc("rank"))


def retrieve_multi_degree(vectors: DataFrame, edges: DataFrame, relations: DataFrame, contents: DataFrame, query: list[float], entities: list, k: int = 5, threshold: float = 0.6, degree: int = 2) -> DataFrame:
    """Vector and graph paths, with what shares entities with the first entity's three heaviest memories over ``degree`` steps (C20).

    Merged, reranked, cut by the threshold and to k rows.
    """
    many = max(4 * k, 20)
    found = vector_search(vectors, query, many).select("id", F.col("similarity").alias("score"))
    graph = graph_search(edges, entities, many).select(F.col("memory").alias("id"), F.col("weight").alias("score"))
    if entities and degree > 1:
        seeds = top(edges.where(F.col("entity") == entities[0]), 3, F.desc("weight"), F.asc("memory")).select(F.col("memory").alias("seed"))
        graph = graph.union(spread(edges, relations, seeds, many).join(graph, "id", "left_anti"))
    merged = F.broadcast(top(merge_two(found, graph.groupBy("id").agg(F.max("score").alias("score"))), 30, F.desc("score"), F.asc("id")))
    ranked = rerank(contents.select("id", "content").join(merged, "id").withColumn("cluster", F.lit(None).cast("string")))
    return top(ranked.where(F.col("score") >= threshold), k, F.desc("score"), F.asc("rank"))


def spread(edges: DataFrame, relations: DataFrame, seeds: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """(id, score): for each seed its k heaviest memories over two steps, other than itself; a memory once with its greatest weight."""
    mine = edges.join(seeds, edges["memory"] == seeds["seed"]).select("seed", F.col("entity").alias("in")).distinct()
    reach = relations.where(F.col("weight") >= least).join(mine, "in").select("seed", F.col("out").alias("entity")).distinct()
    met = edges.join(reach, "entity").where(F.col("memory") != F.col("seed")).groupBy("seed", "memory").agg(F.max("weight").alias("weight"))
    first = top_by(met, k, "seed", F.desc("weight"), F.asc("memory"))
    return first.groupBy(F.col("memory").alias("id")).agg(F.max("weight").alias("score"))


def funnel(vector: DataFrame, graph: DataFrame, merged: DataFrame, final: DataFrame) -> DataFrame:
    """One row of counts: what the paths found, what was merged, what stayed, and its mean score."""
    paths = {"vector": vector, "graph": graph, "merged": merged, "final": final}
    tagged = [df.select(F.lit(n).alias("path"), F.col("score").cast("double").alias("score")) for n, df in paths.items()]
    rows = tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])
    mean = F.coalesce(F.avg(F.when(F.col("path") == "final", F.col("score"))), F.lit(0.0)).alias("mean")
    return rows.agg(*[F.count(F.when(F.col("path") == n, 1)).alias(n) for n in paths], mean)
