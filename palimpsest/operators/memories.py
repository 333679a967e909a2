"""Steps around models: summaries, profiles, topics, merges, relations, compiled blocks; the hierarchy and the context.

A model is a callable (see ``sources.models``); what a prompt holds of each group is bounded, by
ranks that are cut before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import answers as A, entities as E, scores as S, texts as T
from ..sources.models import Encoder, Model, complete, embed
from . import search as R, store as M
from .checkpoints import cut


def _joined(rows: DataFrame, by: str, line: Column, end: str = "\n", *kept: Column) -> DataFrame:
    """A text for each group from its few ranked rows (column ``rank``), one line each."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("at"), line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), end).alias("text"), *kept)


def last_messages(messages: DataFrame, session: str, text: str, *order: str, n: int = 20) -> DataFrame:
    """The last ``n`` messages of each session as one text; null messages are left out."""
    late = R.top_by(messages.where(F.col(text).isNotNull()), n, session, *[F.desc(c) for c in order])
    return _joined(late.withColumn("rank", -F.col("rank")), session, F.col(text))


def summaries(messages: DataFrame, session: str, text: str, model: Model, *order: str) -> DataFrame:
    """A summary of each session's last 20 messages, empty where there is nothing to say, and its ratio of tokens."""
    given = last_messages(messages, session, text, *order)
    said = given.join(complete(given, session, "text", model), session)
    answer = F.coalesce("answer", F.lit(""))
    empty = (answer == "") | F.contains(F.lower(answer), F.lit("no significant content"))
    ratio = F.when(answer != "", S.compression(S.token_estimate(F.col("text")), S.token_estimate(answer))["ratio"])
    return said.select(session, F.when(empty, "").otherwise(answer).alias("summary"), empty.alias("is_empty"), ratio.alias("ratio"))


def profiles(messages: DataFrame, session: str, text: str, model: Model, *order: str) -> DataFrame:
    """Likes, dislikes, facts and habits from each session's last 20 messages."""
    answer = complete(last_messages(messages, session, text, *order), session, "text", model)
    return answer.select(session, A.profile(F.col("answer")).alias("p")).select(session, "p.*")


def entities_or_model(docs: DataFrame, key: str, text: str, model: Model, known: DataFrame | None = None) -> DataFrame:
    """Entities by patterns, and those that a model names in texts without any (H23, H24); keys are unique."""
    found = E.extract_entities(docs, key, text, known)
    said = complete(docs.join(found.select(key).distinct(), key, "left_anti"), key, text, model)
    named = said.select(key, F.explode(E.answered_entities(F.col("answer"))).alias("e")).select(key, "e.name", "e.confidence", F.lit("model").alias("source"))
    return found.unionByName(named, allowMissingColumns=True)


def name_topics(clusters: DataFrame, memories: DataFrame, model: Model) -> DataFrame:
    """Name and description of clusters (cluster, memory) from 200 characters of their five first memories.

    Where the model names nothing, or no memory has a text, the topic is called by its cluster.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("memories"))
    few = R.top_by(clusters, 5, "cluster", F.asc("memory")).join(memories.select(F.col("id").alias("memory"), "content"), "memory")
    few = R.top_by(few.drop("rank").where("content <> ''"), 5, "cluster", F.asc("memory"))
    prompts = _joined(few, "cluster", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.substring("content", 1, 200)))
    said = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), "name string, description string")
    named = sizes.join(complete(prompts, "cluster", "text", model), "cluster", "left").withColumn("said", said)
    fine = (F.col("said.name") != "") & (F.col("said.description") != "")
    return named.select(
        "cluster", F.when(fine, F.trim("said.name")).otherwise(F.concat(F.lit("Topic-"), F.col("cluster"))).alias("name"),
        F.when(fine, F.trim("said.description")).otherwise(F.concat(F.lit("Auto-generated topic for "), F.col("memories"), F.lit(" memories"))).alias("description"), "memories",
    )


def model_clusters(memories: DataFrame, model: Model, *order: Column, most: int = 100, least: int = 5) -> DataFrame:
    """Clusters (cluster, theme, memory) that a model makes of the first ``most`` memories; none of fewer than ``least``."""
    few = R.top_by(R.top(memories.select("id", "content"), most, *(order or [F.asc("id")])).withColumn("all", F.lit(0)), most, "all", *(order or [F.asc("id")]))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("id")))), lambda x: x["id"])
    prompts = _joined(few, "all", F.concat(F.lit("["), F.col("rank") - 1, F.lit("] "), F.coalesce("content", F.lit(""))), "\n", ids.alias("ids")).where(F.size("ids") >= least)
    said = prompts.join(complete(prompts, "all", "text", model), "all").select("ids", F.posexplode(A.clusters(F.col("answer"))).alias("cluster", "c"))
    found = said.select(F.col("cluster").cast("long").alias("cluster"), "c.theme", F.explode("c.places").alias("place"), "ids")
    return found.select("cluster", "theme", F.get("ids", F.col("place")).alias("memory")).where("memory IS NOT NULL").distinct()


def merge_clusters(clusters: DataFrame, memories: DataFrame, model: Model, most: int = 20, least: float = 0.7) -> DataFrame:
    """A merged memory for each cluster (cluster, memory), with the technical names of all its texts.

    The model sees the first ``most`` memories and all names; a cluster of one is its memory.
    ``accepted`` says whether there is a content of more than ``least`` confidence.
    """
    held = clusters.select("cluster", "memory").distinct().join(memories.select(F.col("id").alias("memory"), F.coalesce("content", F.lit("")).alias("content")), "memory")
    names = held.select("cluster", F.explode(E.technical_names(F.col("content"))).alias("name")).distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("name")).alias("names"))
    sizes = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("memories"), F.min_by("content", "memory").alias("own"))
    few = R.top_by(held, most, "cluster", F.asc("memory"))
    prompts = _joined(few, "cluster", F.concat(F.lit("["), F.col("rank") - 1, F.lit("] "), F.col("content"))).join(sizes, "cluster").join(names, "cluster", "left")
    kept = F.when(F.size("names") > 0, F.concat(F.lit("\nTo be kept as they are:\n- "), F.array_join("names", "\n- "))).otherwise("")
    prompts = prompts.withColumn("prompt", F.when(F.col("memories") > 1, F.concat("text", kept)))
    said = prompts.join(complete(prompts, "cluster", "prompt", model), "cluster").withColumn("m", A.merged(F.col("answer")))
    one = F.col("memories") == 1
    out = said.select(
        "cluster", "memories", F.when(one, F.col("own")).otherwise(F.col("m.content")).alias("content"),
        F.when(one, F.coalesce("names", F.array().cast("array<string>"))).otherwise(F.col("m.entities")).alias("entities"),
        F.when(one, 1.0).otherwise(F.col("m.confidence")).alias("confidence"), F.when(one, "single memory").otherwise(F.col("m.reason")).alias("reason"),
    )
    return out.withColumn("accepted", F.col("content").isNotNull() & (F.col("content") != "") & (F.col("confidence") > least))


def model_relations(terms: DataFrame, contexts: DataFrame, model: Model, most: int = 20, least: float = 0.8) -> DataFrame:
    """Relations that a model reads from a document's sure terms and 2,000 characters of its text.

    ``terms`` has doc_id, id, term, normalized, type, domain and confidence, ``contexts`` doc_id
    and text. Lines of ``source | target | kind | evidence`` count where both are known terms; a
    name that several terms have stands for the smallest id.
    """
    sure = terms.where((F.col("confidence") >= least) & (F.col("domain") != "general"))
    listed = _joined(R.top_by(sure, most, "doc_id", F.asc("id")), "doc_id", F.concat(F.lit("- "), F.col("term"), F.lit(" ("), F.col("type"), F.lit(")")), "\n", F.count(F.lit(1)).alias("n")).where("n > 1")
    prompts = listed.withColumnRenamed("text", "list").join(contexts.select("doc_id", F.substring("text", 1, 2000).alias("context")), "doc_id")
    prompts = prompts.select("doc_id", F.concat_ws("\n\n", "list", "context").alias("prompt"))
    lines = complete(prompts, "doc_id", "prompt", model).select("doc_id", F.explode(F.split("answer", "\n")).alias("line"))
    parts = lines.select("doc_id", F.transform(F.split("line", r"\|"), lambda p: F.trim(p)).alias("p")).where(F.size("p") >= 4)
    ids = terms.groupBy("normalized").agg(F.min("id").alias("id"))
    source, target = ids.select(F.col("normalized").alias("s"), F.col("id").alias("in")), ids.select(F.col("normalized").alias("t"), F.col("id").alias("out"))
    said = parts.select("doc_id", F.lower(F.col("p")[0]).alias("s"), F.lower(F.col("p")[1]).alias("t"), F.col("p")[2].alias("relation_type"), F.col("p")[3].alias("evidence"))
    return said.join(source, "s").join(target, "t").select("doc_id", "in", "out", "relation_type", F.lit(0.85).alias("weight"), F.lit(0.9).alias("confidence"), F.lit("llm").alias("method"), "evidence")


def compile_blocks(blocks: DataFrame, known: DataFrame, model: Model, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """Memories of new blocks, and the references of documents' versions to contents.

    ``blocks`` has block_id, text and doc_version, ``known`` content_hash. Of blocks of one
    content the first is read by the model; it is stored if there are triples, a summary and a
    vector of it. Later ones, and those known before, only add a reference.
    """
    hashed = blocks.select("block_id", "text", "doc_version", T.content_hash(F.col("text")).alias("content_hash")).where("text IS NOT NULL")
    first = hashed.groupBy("content_hash").agg(F.min_by("text", "block_id").alias("text"), F.min("block_id").alias("block_id"), F.min_by("doc_version", "block_id").alias("doc_version"))
    new = first.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    said = complete(new, "content_hash", "text", model).select("content_hash", A.sectioned(F.col("answer")).alias("said")).select("content_hash", "said.*").where("summary <> '' AND size(triples) > 0")
    vectors = embed(said, "content_hash", "summary", encoder).where(F.size("embedding") > 0)
    stored = new.join(said, "content_hash").join(vectors, "content_hash").select(
        "block_id", "content_hash", F.col("summary").alias("content"), F.col("text").alias("raw_content"), "triples", "topic", "embedding", "doc_version", F.lit("semantic").alias("type"), F.lit(0.7).alias("importance"), F.lit("compiled").alias("status"),
    )
    referred = hashed.join(stored.select("content_hash").union(known.select("content_hash")).distinct(), "content_hash", "left_semi")
    return stored, referred.groupBy("content_hash").agg(F.array_sort(F.collect_set("doc_version")).alias("doc_versions"), F.count(F.lit(1)).alias("ref_count"))


def remember(memories: DataFrame, rows: DataFrame, kind: str, importance: float) -> DataFrame:
    """The store with new rows of a type: reflections have 0.9, for instance."""
    return memories.unionByName(rows.withColumn("type", F.lit(kind)).withColumn("importance", F.lit(importance)).withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def conflict(memories: DataFrame, content: str, vector: list[float], threshold: float = 0.85, k: int = 5) -> DataFrame:
    """The nearest memory that contradicts a new one, of the ``k`` most similar: no row or one."""
    near = R.vector_search(memories, vector, k, threshold)
    return R.top(near.where(T.conflicting(F.col("content"), F.lit(content))), 1, F.desc("similarity"), F.asc("id"))


def store_checked(memories: DataFrame, new: DataFrame, content: str, vector: list[float], threshold: float = 0.85) -> DataFrame:
    """The store with the row ``new`` and with the memory that it contradicts marked as superseded."""
    gone = conflict(memories, content, vector, threshold).select("id")
    return remember(M.supersede(memories, gone, "id"), new, "semantic", 0.7)


def hierarchy(memories: DataFrame, episodic: float = 0.7, semantic: float = 0.8, reflection: float = 0.85, alike: float = 0.5) -> DataFrame:
    """Similar memories on three levels; reflections hold the semantic ones that share over half of their words.

    Different texts meet by the words that a pair of such a similarity must share one of, the rarer half of each
    text's, and are compared once, however many words they share or memories hold them; texts that are the same, or null, aren't related.
    """
    level = F.expr(f"CASE WHEN type = 'episodic' AND coalesce(similarity, 0) >= {episodic} THEN 1 WHEN type = 'semantic' AND coalesce(similarity, 0) >= {semantic} THEN 2 WHEN type = 'reflection' AND coalesce(similarity, 0) >= {reflection} THEN 3 END")
    held = memories.select("id", "content", "importance", "similarity", level.alias("level")).where("level IS NOT NULL")
    worded = cut(held.where("level > 1").withColumn("words", T.words_over_three(F.col("content"))).where(F.size("words") > 0).select("id", "content", "level", "words"))
    texts = cut(worded.select(F.xxhash64("content").alias("text"), "content", "level", "words").dropDuplicates(["content", "level"]))
    # rare words first, so that few texts meet; the order decides no result
    posts = texts.select("content", "level", F.size("words").alias("size"), F.explode("words").alias("word"))
    ranked = posts.join(posts.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").groupBy("content", "level", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ordered"))
    need = F.floor(F.col("size") * alike).cast("int") + 1  # shared with any text that is alike
    ranked = ranked.select("content", "level", "size", F.explode(F.slice(F.transform("ordered", lambda x: x["word"]), F.lit(1), F.col("size") - need + 1)).alias("word"))
    ranked = cut(ranked.select(F.xxhash64("content").alias("text"), "level", "size", "word"))
    upper = ranked.where("level = 3").select(F.col("text").alias("above"), F.col("size").alias("s"), "word")
    fit = F.least("s", "size") > F.greatest("s", "size") * alike
    met = upper.join(ranked.where("level = 2"), "word").where(fit).select("above", "text").distinct()
    tops = worded.where("level = 3").select(F.col("id").alias("parent"), F.col("content").alias("c"))
    one = texts.where("level = 3").select(F.col("text").alias("above"), F.col("content").alias("c"), F.col("words").alias("w"))
    two = texts.where("level = 2").select("text", "content", "words")
    same = met.join(one, "above").join(two, "text").where((F.col("c") != F.col("content")) & (T.jaccard(F.col("w"), F.col("words")) > alike)).select("c", "content")
    met = tops.select("parent", "c").join(same, "c").join(held.where("level = 2"), "content")
    child = F.struct("id", "content", "importance", "similarity")
    children = met.groupBy("parent", "id").agg(F.first(child).alias("child")).groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children"))
    return held.join(children, (F.col("id") == F.col("parent")) & (F.col("level") == 3), "left").select("level", "id", "content", "importance", "similarity", "children")


#: Lines of a context, those kept for question and answer, and the shares of its sections.
LINES, RESERVED = 300, 47
SHARES = {"reflections": 0.2, "preferences": 0.1, "memories": 0.4, "conversation": 0.3}


def context(sessions: DataFrame, memories: DataFrame, reflections: DataFrame, preferences: DataFrame, conversations: DataFrame) -> DataFrame:
    """(session_id, context): a text of sections for each session of ``sessions``, those with rows only.

    ``memories`` has session_id, place, type and content, ``reflections`` session_id, place and
    summary, ``preferences`` session_id, place, category and item, ``conversations`` session_id
    and text. Places order the rows; five reflections, 15 memories, 25 preferences and 75 lines
    of conversation are said at most.
    """
    room = {k: int((LINES - RESERVED) * v) for k, v in SHARES.items()}

    def section(rows, name, title, most, line):
        few = R.top_by(rows, most, "session_id", F.asc("place"))
        text = _joined(few, "session_id", F.concat(F.lit("- "), line))
        return text.select("session_id", F.concat(F.lit(f"## {title}\n"), "text", F.lit("\n")).alias(name))

    blank = F.lit("")
    parts = [
        section(reflections, "s1", "Reflections", 5, F.coalesce("summary", blank)),
        section(preferences, "s2", "User Preferences", room["preferences"], F.concat("category", F.lit(": "), "item")),
        section(memories.where("type <> 'reflection'"), "s3", "Relevant Memories", 15, F.concat(F.lit("["), "type", F.lit("] "), F.coalesce("content", blank))),
    ]
    lines, most = F.split("text", "\n"), room["conversation"]
    more = F.when(F.size(lines) > most, F.concat(F.lit("\n... ("), F.size(lines) - most, F.lit(" more lines)"))).otherwise("")
    said = conversations.where("text <> ''").select("session_id", F.concat(F.lit("## Recent Conversation\n"), F.array_join(F.slice(lines, 1, most), "\n"), more, F.lit("\n")).alias("s4"))
    out = sessions.select("session_id").distinct()
    for p in [*parts, said]:
        out = out.join(p, "session_id", "left")
    return out.select("session_id", F.concat_ws("\n", F.concat(F.lit("# Memory Context for Session: "), "session_id"), "s1", "s2", "s3", "s4").alias("context"))
