"""Tables of the store: keyed merges, patches, deletes, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import days_between, half_life
from . import similar


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """A row by key; the predicate reaches the scan."""
    return table.where(F.col(key) == value)


def scroll(table: DataFrame, predicate: Column, limit: int, *order: Column) -> DataFrame:
    """A page of the rows that fit."""
    return table.where(predicate).orderBy(*order).limit(limit)


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first by ``order``; without one, that whose JSON is largest, so that reruns agree."""
    order = order or (F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])).desc(),)
    place = "place"
    while place in rows.columns:
        place = f"_{place}"
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) == 1).drop(place)


def upsert(table: DataFrame, rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """New rows replace those of the same key, one a key (A10, K3, K4, K6); ``order`` says which of several."""
    rows = latest(rows, key, *order)
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def patch(table: DataFrame, changes: DataFrame, key: str, *order: Column, at: Column | None = None) -> DataFrame:
    """Columns that a change gives, where they are not null, replace the row's (A11, A35); ``order`` says which of several changes of a key.

    With ``at``, the changed rows' ``updated_at`` is that.
    """
    changes = latest(changes, key, *order)
    if at is not None and "updated_at" in table.columns:
        changes = changes.withColumn("updated_at", at)
    names = [c for c in changes.columns if c != key and c in table.columns]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(A12, K5)"""
    return table.join(keys.select(key), key, "left_anti")


def without_session(table: DataFrame, session) -> DataFrame:
    """(A13)"""
    return table.where(~F.col("session_id").eqNullSafe(F.lit(session)))


def payload(table: DataFrame) -> DataFrame:
    """Defaults for what is missing; an importance of 0 counts as missing."""
    weight = F.expr("try_cast(importance AS double)")
    return table.select(
        "id", F.coalesce("type", F.lit("episodic")).alias("type"), F.when(weight.isNull() | (weight == 0), 0.5).otherwise(weight).alias("importance"),
        F.coalesce(F.expr("try_cast(access_count AS bigint)"), F.lit(0)).alias("access_count"), F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )


def defaults(rows: DataFrame, values: dict) -> DataFrame:
    """Columns that are missing, or null, get these values (A10)."""
    put = {c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in values.items()}
    return rows.withColumns(put)


def fitting(table: DataFrame, type: str | None = None, session: str | None = None, active: bool = True) -> DataFrame:
    """Rows of a type and a session, where these are given, that are active (B1)."""
    kept = table.where(F.coalesce("is_active", F.lit(True))) if active else table
    kept = kept.where(F.col("type") == type) if type is not None else kept
    return kept.where(F.col("session_id") == session) if session is not None else kept


def by_importance(table: DataFrame, type: str, n: int) -> DataFrame:
    """The most important rows of a type (F3 with 20 semantic ones, F4 with 5 reflections)."""
    return fitting(table, type).orderBy(F.desc("importance"), F.asc("id")).limit(n)


def type_counts(table: DataFrame, by: str = "type") -> DataFrame:
    """Rows of each type and, with a null type, of all."""
    return table.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count(F.lit(1)).alias("n"))


def entity_stats(entities: DataFrame, edges: DataFrame, topics: DataFrame) -> DataFrame:
    """Links and topics of every entity."""
    links = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("links"))
    under = topics.groupBy(F.col("parent").alias("entity")).agg(F.count(F.lit(1)).alias("topics"))
    both = entities.select("entity").join(links, "entity", "left").join(under, "entity", "left")
    return both.select("entity", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("topics", F.lit(0)).alias("topics"))


def entity_type_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and links of every type of entity."""
    counts = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return entities.join(counts, "entity", "left").groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.coalesce("n", F.lit(0))).alias("links"))


def compiled_stats(blocks: DataFrame) -> DataFrame:
    """Blocks and triples of each version of documents."""
    return blocks.groupBy("doc_version").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("triples")).alias("triples"))


def pending(state: DataFrame, status: str | None = None) -> DataFrame:
    """Documents of a status, or all that aren't completed, the oldest first."""
    due = F.col("status") == status if status is not None else ~F.col("status").eqNullSafe(F.lit("completed"))
    return state.where(due).orderBy(F.asc("imported_at"), F.asc("file_path"))


def processed(state: DataFrame) -> DataFrame:
    """Documents that need nothing more."""
    return state.where((F.col("status") == "completed") & F.col("entities_extracted") & F.col("relations_extracted"))


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, file_hash) that are new, or not as they were imported (A23, A24, A30, A31); files that are gone change nothing."""
    known = state.where(F.col("status") != "error").select(F.col("file_path").alias("path"), "file_hash")
    return files.join(known, ["path", "file_hash"], "left_anti")


def set_version(spark, folder: str, version: int = 1) -> None:
    """(A15)"""
    spark.createDataFrame([("schema_version", version)], "name string, value int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/metadata")


def get_version(spark, folder: str) -> int | None:
    """The version stored in the folder, or None."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("name string, value int").parquet(f"{folder}/metadata").where("name = 'schema_version'").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row["value"] if row else None


def near_duplicates(rows: DataFrame, near: float = 0.95, within: str | None = "session_id") -> DataFrame:
    """(id, other, similarity): the nearest row of a smaller id, of the same ``within``, for each row that it resembles this much.

    Rows: id, embedding and ``within``; one without ``within`` resembles none.
    """
    rows = rows.where(F.col(within).isNotNull()) if within else rows
    return similar.nearest_earlier(rows, near, F.col(within) if within else None)


def known_before(new: DataFrame, stored: DataFrame, near: float = 0.95, within: str | None = None) -> DataFrame:
    """Keys of new rows that a stored row resembles this much, of the same ``within`` if that is given."""
    return similar.alike(new, stored, near, F.col(within) if within else None)


def maintained(memories: DataFrame, uses: DataFrame, at: Column, days: int = 90, least: int = 10) -> DataFrame:
    """The memories with ``change``: ``kept``, ``changed`` or ``deleted``.

    Importance halves every 30 days since a memory was made or last changed; an episodic one of ``least`` uses becomes
    semantic; one that wasn't used for ``days`` becomes inactive, and is deleted when it has been so for as long again.
    ``uses`` has id, access_count and last_accessed. What was changed at ``at`` isn't changed by a second run.
    """
    held = memories.join(uses.select("id", "access_count", F.col("last_accessed").alias("__last")), "id", "left")
    since, idle = days_between(F.coalesce("updated_at", "created_at"), at), days_between(F.greatest("created_at", "__last"), at)
    active = F.coalesce("is_active", F.lit(True))
    new = {
        "importance": half_life(F.col("importance"), since), "type": F.when((F.col("type") == "episodic") & (F.coalesce("access_count", F.lit(0)) >= least), "semantic").otherwise(F.col("type")),
        "is_active": active & ~F.coalesce(idle >= days, F.lit(False)),
    }
    gone = ~active & F.coalesce((since >= days) & (idle >= days), F.lit(False))
    differs = ~new["importance"].eqNullSafe(F.col("importance")) | ~new["type"].eqNullSafe(F.col("type")) | (new["is_active"] != active)
    told = held.withColumn("change", F.when(gone, "deleted").when(differs, "changed").otherwise("kept"))
    put = {c: F.when(F.col("change") == "changed", e).otherwise(F.col(c)) for c, e in {**new, "updated_at": at}.items()}
    return told.select(*[put[c].alias(c) if c in put else F.col(c) for c in memories.columns], "change")


def record_key(record: Column) -> Column:
    """What follows the last colon of ``table:id``, without the brackets of a quoted id; null if nothing does."""
    return F.nullif(F.btrim(F.element_at(F.split(record, ":"), -1), F.lit("⟨⟩` ")), F.lit(""))


def record_id(record: Column) -> Column:
    """The number after the last colon of ``table:id``, or null."""
    return F.element_at(F.split(record, ":"), -1).try_cast("bigint")


def count_entities(mentions: DataFrame) -> DataFrame:
    """Entities by exact name with mentions, first and last time, and their first type (K1)."""
    return mentions.groupBy("name").agg(F.count(F.lit(1)).alias("mention_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_mentioned_at"), F.min_by("type", "ts").alias("type"))


def increment(table: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """access_count plus a row's uses."""
    n = uses.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return table.join(n, key, "left").withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def expire(table: DataFrame, column: str, reference, days: int = 90) -> DataFrame:
    """Rows used within so many days of the reference time."""
    return table.where(F.col(column) >= F.expr(f"{reference} - INTERVAL {days} DAYS"))


def promote(table: DataFrame, least: int = 10) -> DataFrame:
    """Episodic rows with enough accesses become semantic, with their vectors."""
    due = (F.col("type") == "episodic") & (F.col("access_count") >= least)
    return table.withColumn("type", F.when(due, "semantic").otherwise(F.col("type")))


def supersede(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(K24)"""
    gone = keys.select(key, F.lit(True).alias("__gone")).distinct()
    return table.join(gone, key, "left").withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).drop("__gone")


def references(blocks: DataFrame) -> DataFrame:
    """Content by hash: versions that hold it, and how often."""
    return blocks.groupBy("content_hash").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.count(F.lit(1)).alias("ref_count"))


def store_terms(mentions: DataFrame) -> DataFrame:
    """Terms by normalised name and domain with frequency and documents."""
    return mentions.groupBy("normalized", "domain").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.collect_set("doc")).alias("docs"), F.max("confidence").alias("confidence"))


def last_n(messages: DataFrame, session: str, n: int, *order: Column) -> DataFrame:
    """The last n messages of each session (J5); a rank limit before the shuffle keeps hot sessions small."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return messages.withColumn("rank", rank).where(F.col("rank") <= n)


def batches(messages: DataFrame, session: str, n: int, *order: Column) -> DataFrame:
    """Messages of a session in batches of n, in order."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return messages.withColumn("batch", F.floor((rank - 1) / n).cast("long"))


def sessions(events: DataFrame, by: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of events with no pause of ``gap`` between them."""
    return events.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")
