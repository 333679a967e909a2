"""Indexing of new memories into the entity graph, and labels for its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.answers import relation_label
from ..sources.models import Model, complete
from .documents import leader_clusters

#: Mentions below which a known entity waits, and links from which one is due for topics or frozen.
MENTIONS, SPLIT, FROZEN = 3, 400, 500


def recent_mentions(mentions: DataFrame, by: str, ts: str = "ts", hours: int = 24) -> DataFrame:
    """``n``: mentions of the same key in less than so many hours up to each, itself included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    near = Window.partitionBy(by).orderBy(micros).rangeBetween(1 - hours * 3_600_000_000, 0)
    return mentions.withColumn("n", F.count(F.lit(1)).over(near))


def known_entities(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(entity, mentions, confidence) of the entities of most links: sure by 0.05 a link from 0.7 on, up to 0.95 (F2)."""
    counted = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions")).withColumn("confidence", F.least(F.lit(0.95), 0.7 + 0.05 * F.col("mentions")))
    return counted.orderBy(F.desc("mentions"), F.asc("entity")).limit(most)


def entity_ids(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows with ``name`` and the entity of exactly that name as ``entity``, 0 without one (B10); of several the smallest."""
    known = entities.groupBy("name").agg(F.min("id").alias("entity"))
    return names.join(known, "name", "left").withColumn("entity", F.coalesce("entity", F.lit(0).cast("long")))


def frequencies(recent: DataFrame, entities: DataFrame) -> DataFrame:
    """The larger of an entity's recent mentions, by its name in lower case, and its stored count (K9)."""
    now = recent.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("recent"))
    held = entities.groupBy(F.lower("name").alias("name")).agg(F.max("mention_count").alias("stored"))
    both = now.join(held, "name", "full_outer")
    return both.select("name", F.greatest(F.coalesce("recent", F.lit(0)), F.coalesce("stored", F.lit(0))).cast("long").alias("frequency"))


def freeze(entities: DataFrame, ids: DataFrame, reason: str, at: Column) -> DataFrame:
    """Marks entities frozen; those frozen before keep their reason and time (K8)."""
    due = ids.select(F.col("id"), F.lit(True).alias("due")).distinct()
    joined = entities.join(due, "id", "left")
    new = F.col("due").isNotNull() & ~F.coalesce("is_frozen", F.lit(False))
    put = {"is_frozen": F.coalesce("is_frozen", F.lit(False)) | F.col("due").isNotNull(), "freeze_reason": F.when(new, reason).otherwise(F.col("freeze_reason")), "frozen_at": F.when(new, at).otherwise(F.col("frozen_at"))}
    return joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in entities.columns])


def indexable(found: DataFrame, frequency: DataFrame, entities: DataFrame, least: int = MENTIONS, hard: int = FROZEN) -> DataFrame:
    """Of the rows (memory, name, confidence) those to be linked.

    A new name passes; a known one waits until it is mentioned ``least`` times, and is left out if
    it is frozen or has ``hard`` links. The link of a memory and a name keeps its greatest confidence.
    """
    held = entities.groupBy(F.lower("name").alias("key")).agg(F.bool_or(F.coalesce("is_frozen", F.lit(False)) | (F.coalesce("relation_count", F.lit(0)) >= hard)).alias("closed"))
    known = frequency.select(F.lower("name").alias("key"), "frequency").groupBy("key").agg(F.max("frequency").alias("frequency"))
    rows = found.withColumn("key", F.lower("name")).join(known, "key", "left").join(held, "key", "left")
    times = F.coalesce("frequency", F.lit(0))
    passed = rows.where(((times == 0) | (times >= least)) & ~F.coalesce("closed", F.lit(False)))
    return passed.groupBy("memory", "name").agg(F.max("confidence").alias("weight"))


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (memory, entity, weight) with the new ones, which replace those of the same ends (K2)."""
    one = new.groupBy("memory", "entity").agg(F.max("weight").alias("weight"))
    return edges.join(one, ["memory", "entity"], "left_anti").select("memory", "entity", "weight").union(one.select("memory", "entity", "weight"))


def interval(queue: Column, memory: Column, cpu: Column, calm: int = 100, memory_limit: float = 0.8, cpu_limit: float = 0.7, shortest: float = 5_000.0, longest: float = 60_000.0) -> Column:
    """Milliseconds between two rounds, between the limits by the greatest of three pressures."""
    over = lambda x, limit, span: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - limit) / span))
    pressure = F.greatest(over(queue, calm, calm), over(memory, memory_limit, 1 - memory_limit), over(cpu, cpu_limit, 1 - cpu_limit))
    return shortest + (longest - shortest) * pressure


def next_tasks(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The tasks to do next: those of priority first, then in the order they were added."""
    return tasks.orderBy(F.desc("priority"), F.asc("added_at"), F.asc("entity")).limit(n)


def unlabelled(relations: DataFrame, most: int = 100) -> DataFrame:
    """The oldest edges without a label or not refined yet."""
    due = (F.col("relation_type") == "co_occurs") | ~F.col("is_manual_refined")
    return relations.where(due).orderBy("created_at", "in", "out").limit(most)


def snippets(relations: DataFrame, memories: DataFrame, names: DataFrame, most: int = 3, around: int = 100) -> DataFrame:
    """(in, out, snippets): what some of an edge's memories say around either name, joined by `` | ``.

    ``most`` memories of the evidence are taken, evenly spread over their time; of each the stretch
    around the first of the two names, or its beginning.
    """
    said = relations.select("in", "out", F.explode(F.array_distinct("evidence_memory_ids")).alias("id"))
    said = said.join(memories.select("id", "content", "created_at"), "id").where("content <> ''")
    pair = Window.partitionBy("in", "out")
    placed = said.withColumn("place", F.row_number().over(pair.orderBy("created_at", "id")) - 1).withColumn("held", F.count(F.lit(1)).over(pair))
    step = F.greatest(F.lit(1), F.floor(F.col("held") / most))
    some = placed.where((F.col("place") % step == 0) & (F.col("place") / step < most))
    named = lambda side: names.select(F.col("id").alias(side), F.lower("name").alias(f"{side}_name"))
    some = some.join(named("in"), "in", "left").join(named("out"), "out", "left")
    spot = lambda c: F.nullif(F.coalesce(F.expr(f"locate({c}, lower(content))"), F.lit(0)), F.lit(0))
    at = F.least(spot("in_name"), spot("out_name"))
    size = F.when(F.col("at") == spot("in_name"), F.length("in_name")).otherwise(F.length("out_name"))
    start = F.greatest(F.lit(1), F.col("at") - around)
    window = F.when(F.col("at").isNull(), F.left("content", F.lit(2 * around))).otherwise(F.substring(F.col("content"), start, F.col("at") + size + around - start))
    some = some.withColumn("at", at).withColumn("said", window)
    return some.groupBy("in", "out").agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("s")).select("in", "out", F.array_join(F.transform("s", lambda s: s["said"]), " | ").alias("snippets"))


def labelled(relations: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with the labels (in, out, relation_type, confidence, reasoning, reverse, source) given to them.

    An edge turns round where its label says so, or names the far end as the source. Edges without a label stay.
    """
    far = names.select(F.col("id").alias("out"), F.lower("name").alias("out_name"))
    said = labels.select("in", "out", *[F.col(c).alias(f"new_{c}") for c in ("relation_type", "confidence", "reasoning", "source")], "reverse")
    both = relations.join(said, ["in", "out"], "left").join(far, "out", "left")
    told = F.col("new_relation_type").isNotNull()
    turn = told & (F.coalesce("reverse", F.lit(False)) | F.coalesce(F.lower("new_source") == F.col("out_name"), F.lit(False)))
    put = {"in": F.when(turn, F.col("out")).otherwise(F.col("in")), "out": F.when(turn, F.col("in")).otherwise(F.col("out")), "is_manual_refined": F.col("is_manual_refined") | told}
    for c in ("relation_type", "confidence", "reasoning", "source"):
        if c in relations.columns:
            put[c] = F.when(told, F.col(f"new_{c}")).otherwise(F.col(c))
    return both.select(*[put[c].alias(c) if c in put else F.col(c) for c in relations.columns])


def classify_relations(relations: DataFrame, entities: DataFrame, memories: DataFrame, model: Model, most: int = 100) -> DataFrame:
    """All edges; the oldest unlabelled ones with the label that the model gives for names and snippets."""
    due = unlabelled(relations, most)
    names = entities.select("id", "name")
    asked = due.join(names.select(F.col("id").alias("in"), F.col("name").alias("a")), "in").join(names.select(F.col("id").alias("out"), F.col("name").alias("b")), "out")
    asked = asked.join(snippets(due, memories, names), ["in", "out"], "left")
    prompt = F.concat_ws("\n", F.lit("How do these two relate? Answer as JSON: relation_type, confidence, reasoning, reverse_direction, source."), "a", "b", F.coalesce("snippets", F.lit("")))
    asked = asked.select(F.struct("in", "out").alias("key"), prompt.alias("prompt"))
    said = complete(asked, "key", "prompt", model).select("key.*", relation_label(F.col("answer")).alias("l"))
    return labelled(relations, said.select("in", "out", "l.*"), names)


def supernode_topics(edges: DataFrame, vectors: DataFrame, most: int = 200, least: int = 5, split: int = SPLIT, near: float = 0.7, left: float = 0.5) -> DataFrame:
    """Topics for entities of ``split`` links or more: (entity, topic, memory, weight).

    The ``most`` heaviest memories of an entity that have a vector are clustered; each cluster is a
    topic with links of 0.8, and what fits none goes to ``Archive`` with links of 0.3. Entities with
    fewer than ``least`` such memories get none. Names are numbers, which a model may replace.
    """
    size = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") >= split)
    heavy = edges.join(size, "entity").join(vectors.select(F.col("id").alias("memory"), "embedding"), "memory")
    heavy = heavy.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("weight"), "memory"))).where(F.col("place") <= most)
    enough = heavy.groupBy("entity").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= least).select("entity")
    rows = heavy.join(enough, "entity").select(F.col("memory").alias("id"), F.col("entity").alias("group"), "embedding", "place")
    found = leader_clusters(rows, "group", near, 10, left, most, "place")
    noise = F.col("cluster") < 0
    topic = F.when(noise, "Archive").otherwise(F.concat(F.lit("Topic "), (F.col("cluster") + 1).cast("string")))
    return found.select(F.col("group").alias("entity"), topic.alias("topic"), F.col("id").alias("memory"), F.when(noise, 0.3).otherwise(0.8).alias("weight"))
