"""The entity graph: co-occurrence, degrees, aliases, relations, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scores import cosine
from . import similar
from .checkpoints import cut

#: Sizes that are broadcast; more are joined by shuffle.
BROADCAST = 100_000


def entity_pairs(links: DataFrame, block: int = 1000) -> DataFrame:
    """(memory, in, out) with in < out: all pairs of a memory's entities that hold a new link, each once.

    Rows (memory, entity, new), one a link. The memories are dealt once, and joined where they are; one of more than
    ``block`` links is cut into blocks by its entities' hash, and every two blocks are paired in a task of their own.
    """
    own = links.repartition("memory")
    sizes = links.groupBy("memory").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size"))
    ends = [F.least("a.entity", "b.entity").alias("in"), F.greatest("a.entity", "b.entity").alias("out")]
    new = F.col("a.new") | F.col("b.new")
    known = sizes.limit(BROADCAST + 1).count()
    if not known:
        return own.alias("a").join(own.alias("b"), "memory").where((F.col("a.entity") < F.col("b.entity")) & new).select("memory", *ends)
    sizes = F.broadcast(sizes) if known <= BROADCAST else sizes
    small = own.join(sizes, "memory", "left_anti")
    pairs = small.alias("a").join(small.alias("b"), "memory").where((F.col("a.entity") < F.col("b.entity")) & new).select("memory", *ends)
    dealt = links.join(sizes, "memory").withColumn("mine", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("memory", "entity", "new", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    met = dealt.alias("a").join(dealt.alias("b"), ["memory", "low", "high"])
    # Two entities of one block meet wherever it is paired, and count where it is paired with itself.
    met = met.where((F.col("a.entity") < F.col("b.entity")) & new & ((F.col("a.mine") != F.col("b.mine")) | (F.col("low") == F.col("high"))))
    return pairs.unionByName(met.select("memory", *ends))


def _links(edges: DataFrame, new: bool = True) -> DataFrame:
    return edges.select("memory", "entity").where("memory IS NOT NULL AND entity IS NOT NULL").distinct().withColumn("new", F.lit(new))


def cooccurrence(edges: DataFrame, least: int = 3, block: int = 1000) -> DataFrame:
    """Pairs of entities in ``least`` memories or more, weighted by their mentions (C12); a mention without a memory counts as one."""
    counts = entity_pairs(_links(edges), block).groupBy("in", "out").agg(F.count(F.lit(1)).alias("n"))
    return weighted(counts, mentions(edges.select("memory", "entity").distinct()), least).select("in", "out", "n", "weight")


def mentions(links: DataFrame) -> DataFrame:
    """Memories of each entity."""
    return links.groupBy("entity").agg(F.count(F.lit(1)).alias("m"))


def weighted(counts: DataFrame, held: DataFrame, least: int = 3, refined: DataFrame | None = None) -> DataFrame:
    """Relations of the pairs (in, out, n) in ``least`` memories or more, over the roots of their mentions.

    A pair that ``refined`` (in, out, type) has keeps that type; others co-occur.
    """
    left = held.select(F.col("entity").alias("in"), F.col("m").alias("ma"))
    right = held.select(F.col("entity").alias("out"), F.col("m").alias("mb"))
    known = counts.where(F.col("n") >= least).join(left, "in").join(right, "out")
    known = known.withColumn("weight", F.col("n") / F.sqrt(F.col("ma") * F.col("mb"))).drop("ma", "mb")
    if refined is None:
        return known.withColumn("type", F.lit("co_occurs"))
    types = refined.groupBy("in", "out").agg(F.max("type").alias("type"))
    return known.join(types, ["in", "out"], "left").withColumn("type", F.coalesce("type", F.lit("co_occurs")))


def added_pairs(held: DataFrame, new: DataFrame, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The pairs (memory, in, out) and the links (memory, entity) that new links add to those held: only memories with a new link are paired.

    A link that is held already, or comes twice, or has a null end adds nothing. The pairs are the evidence of their relation; their numbers add up to its count.
    """
    fresh = _links(new).join(held.select("memory", "entity"), ["memory", "entity"], "left_anti")
    old = _links(held.join(fresh.select("memory").distinct(), "memory", "left_semi"), False)
    return entity_pairs(fresh.unionByName(old), block), fresh.select("memory", "entity")


def merged_counts(held: DataFrame, added: DataFrame, *keys: str) -> DataFrame:
    """Counts by key: those held (the keys and a number), and one for each row added."""
    number = next(c for c in held.columns if c not in keys)
    more = added.groupBy(*keys).agg(F.count(F.lit(1)).alias(number))
    return held.unionByName(more).groupBy(*keys).agg(F.sum(number).alias(number))


def prune(relations: DataFrame, least: float) -> DataFrame:
    """Edges of this weight or more; the lighter ones go."""
    return relations.where(F.col("weight") >= least)


def relation_stats(relations: DataFrame, kind: str) -> DataFrame:
    """Count and mean, greatest and least weight, over all and by kind."""
    return relations.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean"), F.max("weight").alias("greatest"), F.min("weight").alias("least"))


def degrees(edges: DataFrame, soft: int = 400, hard: int = 500) -> DataFrame:
    """Links of each entity, and whether it is due for topics or frozen."""
    counted = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("links"))
    return counted.select("entity", "links", (F.col("links") >= soft).alias("split"), (F.col("links") >= hard).alias("frozen"))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """Each alias with what it stands for at last; aliases that lead round in a circle resolve to null.

    Rows (alias, target); of several targets of an alias the largest counts. Every round doubles
    the steps taken, so that chains among n aliases end within log n rounds, and what still moves is circular.
    """
    step = cut(aliases.groupBy("alias").agg(F.max("target").alias("canonical")))
    for _ in range(step.count().bit_length()):
        further = step.select(F.col("alias").alias("canonical"), F.col("canonical").alias("further"))
        moved = step.join(further, "canonical", "left").groupBy("alias").agg(F.max(F.coalesce("further", "canonical")).alias("canonical"))
        step = cut(moved)
    known = step.select(F.col("alias").alias("canonical"), F.lit(True).alias("circle"))
    return step.join(known, "canonical", "left").select("alias", F.when(F.col("circle").isNull(), F.col("canonical")).alias("canonical"))


def repoint(edges: DataFrame, canonical: DataFrame, weight: float = 0.9) -> DataFrame:
    """Edges of aliases become edges of what they stand for, with the weight of a merge; each pair once."""
    known = canonical.select(F.col("alias").alias("entity"), "canonical")
    moved = edges.join(known, "entity", "left").select("memory", F.coalesce("canonical", "entity").alias("entity"), F.when(F.col("canonical").isNull(), F.col("weight")).otherwise(weight).alias("weight"))
    return moved.groupBy("memory", "entity").agg(F.max("weight").alias("weight"))


def winning_relations(relations: DataFrame) -> DataFrame:
    """Of the relations between two ends, that of the strongest method, then of most confidence."""
    strength = F.when(F.col("method") == "rule", 4).when(F.col("method") == "llm", 3).when(F.col("method") == "embedding", 2).otherwise(1)
    order = Window.partitionBy("in", "out").orderBy(strength.desc(), F.desc("confidence"), "type")
    return relations.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def upsert_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Relations by ends and type: greatest weight and confidence, method of most confidence."""
    both = old.unionByName(new)
    return both.groupBy("in", "out", "type").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max_by("method", F.struct("confidence", "method")).alias("method"))


def semantic_pairs(vectors: DataFrame, related: float = 0.7, synonym: float = 0.85) -> DataFrame:
    """Pairs of terms by cosine."""
    found = similar.pairs(vectors, related).select(F.col("a").alias("in"), F.col("b").alias("out"), F.col("similarity").alias("weight"))
    return found.withColumn("type", F.when(F.col("weight") > synonym, "synonym").otherwise("related_to"))


def centroids(links: DataFrame, vectors: DataFrame, most: int = 50) -> DataFrame:
    """Mean vector of each topic's first ``most`` memories."""
    few = links.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("memory"))).where(F.col("rank") <= most)
    parts = few.join(vectors.select(F.col("id").alias("memory"), "embedding"), "memory").select("topic", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("topic", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return listed.select("topic", F.transform("v", lambda s: s["x"]).alias("centroid"))


def aliases_of(aliases: DataFrame) -> DataFrame:
    """The aliases of each entity, in order (C11)."""
    return aliases.groupBy("entity").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def merged_entities(entities: DataFrame, canonical: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """The entities with those that stand for another marked merged, and the rows (alias, entity_id) of their names."""
    known = canonical.where("canonical IS NOT NULL AND canonical <> alias").select(F.col("alias").alias("id"), "canonical")
    joined = entities.drop("canonical_id", "is_merged", "merged_at").join(known, "id", "left")
    gone = F.col("canonical").isNotNull()
    marked = joined.withColumn("is_active", F.coalesce("is_active", F.lit(True)) & ~gone).withColumn("is_merged", gone).withColumn("merged_at", F.when(gone, at))
    marked = marked.withColumnRenamed("canonical", "canonical_id")
    names = marked.where("is_merged").select(F.col("name").alias("alias"), F.col("canonical_id").alias("entity_id"))
    return marked, names


def mount(vectors: DataFrame, topic_centroids: DataFrame, least: float = 0.6, most: int = 1000) -> DataFrame:
    """The nearest topic of each memory, if it is nearer than ``least``.

    Topics are few: ``most`` of them become literals of one projection, without a join. Of more, each memory
    is joined to all in blocks of topics, and its best is kept by a maximum that is combined before the shuffle.
    """
    rows = topic_centroids.select("topic", "centroid").orderBy("topic").limit(most + 1).collect()
    if len(rows) > most:
        part = F.pmod(F.xxhash64("topic"), F.lit(32))
        many = topic_centroids.select("topic", "centroid", part.alias("part"))
        asked = vectors.select("id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("part"))
        scored = asked.join(many, "part").select("id", "topic", cosine(F.col("embedding"), F.col("centroid")).alias("similarity"))
        best = scored.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("topic")).alias("order"))).alias("b"))
        return best.select("id", (-F.col("b.order")).cast("long").alias("topic"), F.col("b.similarity").alias("similarity")).where(F.col("similarity") > least)
    if not rows:
        return vectors.select("id", F.lit(None).cast("long").alias("topic"), F.lit(0.0).alias("similarity")).where("false")
    scored = [F.struct(cosine(F.col("embedding"), F.array(*map(F.lit, r["centroid"]))).alias("similarity"), F.lit(-r["topic"]).alias("order")) for r in rows]
    best = vectors.select("id", F.array_max(F.array(*scored)).alias("b"))
    return best.select("id", (-F.col("b.order")).cast("long").alias("topic"), F.col("b.similarity").alias("similarity")).where(F.col("similarity") > least)


def merge_synonyms(relations: DataFrame, frequencies: DataFrame, least: float = 0.99) -> DataFrame:
    """(primary, merged, frequency) of each synonym pair; the more frequent is primary, ties go to the first."""
    f = frequencies.select(F.col("id"), F.col("frequency"))
    pairs = relations.where((F.col("type") == "synonym") & (F.col("weight") > least))
    both = pairs.join(f.select(F.col("id").alias("in"), F.col("frequency").alias("fi")), "in").join(f.select(F.col("id").alias("out"), F.col("frequency").alias("fo")), "out")
    first = F.col("fi") >= F.col("fo")
    return both.select(F.when(first, F.col("in")).otherwise(F.col("out")).alias("primary"), F.when(first, F.col("out")).otherwise(F.col("in")).alias("merged"), (F.col("fi") + F.col("fo")).alias("frequency"))


# Names that tell a term's kind: pattern, what it belongs to, how.
NAMING_RULES = [
    ("^pg_", "system_object", "is_a"), ("(?i)index$", "index", "part_of"), ("(?i)buffer$", "memory", "part_of"),
    ("^shared_|^max_|^min_|^default_", "configuration", "is_a"), ("(?i)dump|restore|backup|import|export$", "tool", "is_a"),
]


def structural_relations(terms: DataFrame) -> DataFrame:
    """A relation for every rule that a term's name (``normalized``) follows (C14); the targets are names that the store adds."""
    rules = F.array(*[F.when(F.col("normalized").rlike(p), F.struct(F.lit(t).alias("target"), F.lit(r).alias("type"))) for p, t, r in NAMING_RULES])
    found = terms.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return found.select("id", "r.target", "r.type", F.lit(0.8).alias("weight"), F.lit(0.95).alias("confidence"), F.lit("rule").alias("method"))
