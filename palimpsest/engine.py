"""The engine as one object over a folder of tables, and its command line (A2, A4, A7, A14, A15, A23-A35, C16, C17, D20-D23, F2, K8, K11, K18, K21, K22, K25, K26, K37, K39, K40, L1, L2, L7-L9, M3).

``python -m palimpsest store|search|list|stats|import|terms --folder F [text]``
"""

from __future__ import annotations

import argparse
import os
import re
import uuid
import zlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .functions import entities as E, texts as T
from .operators import documents as D, graph as G, indexing as I, memories as P, search as R, store as M, term_import as TI, terms as X
from .operators.checkpoints import cut
from .sources import files
from .sources.models import Encoder, Model, embed, hashed_encoder, unit
from .streaming import messages

#: The tables of the store.
SCHEMAS = {
    "memory": "id long, type string, content string, embedding array<double>, importance double, session_id string, created_at timestamp, updated_at timestamp, is_active boolean, content_hash string, source string",
    "entity": "name string, is_frozen boolean, freeze_reason string, frozen_at timestamp",
    "memory_entity": "memory long, entity string, weight double, created_at timestamp",
    "topic": "topic long, name string, parent string, links long, created_at timestamp",
    "topic_memory": "topic long, memory long, weight double",
    "access": "id long, ts timestamp",
    "document_import_state": "file_path string, file_hash string, imported_at timestamp, chunks_count long, entities_extracted boolean, relations_extracted boolean, status string, error string",
    "compiled": "block_id string, content_hash string, content string, raw_content string, triples array<struct<subject: string, relation: string, object: string>>, topic string, embedding array<double>, doc_version string, type string, importance double, status string",
    "term_document": "doc string, content_hash string, imported_at timestamp, run string",
    "term_block": "doc string, block int, domain string, term string, normalized string, namespace string, type string, label string, source string, kind string, freq long, score double, confidence double, error string, run string",
}
MEMORY = SCHEMAS["memory"]
#: The schema's version, the similarity from which a memory is a duplicate, and characters beyond which a document is cut simply.
VERSION, DUPLICATE, LARGE = 2, 0.95, 100_000
#: Confidence from which an entity of a query opens the graph and topic paths.
SURE = 0.7


class Engine:
    """Memories in Parquet under ``folder``; texts become vectors by ``encoder``, a callable."""

    def __init__(self, spark: SparkSession, folder: str, encoder: Encoder | None = None):
        self.spark, self.folder, self.encoder = spark, folder, encoder or hashed_encoder()

    def table(self, name: str, *more: str) -> DataFrame:
        """A table of the store, empty if nothing was written (A4); ``more`` may name ``op``, the write that a row came with."""
        schema = f"{SCHEMAS[name]}, op string"
        columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMAS[name])]
        try:
            held = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = self.spark.createDataFrame([], schema)
        return held.select(*columns, *more)

    def append(self, name: str, rows: DataFrame, op: str | None = None) -> None:
        """Adds rows as one write, which replaces what an earlier write of the same ``op`` left, as when a batch is repeated."""
        rows.select(*self.table(name).columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/op={op or f'w{uuid.uuid4().hex}'}")

    def create(self) -> None:
        """Empty tables, and the schema's version."""
        for name in SCHEMAS:
            self.append(name, self.spark.createDataFrame([], SCHEMAS[name]), "created")
        M.set_version(self.spark, self.folder, VERSION)

    def healthy(self) -> bool:
        """Whether the tables of the store's version are there."""
        return M.get_version(self.spark, self.folder) == VERSION

    def memories(self) -> DataFrame:
        """The table of memories, empty if none was stored."""
        return self.table("memory")

    def vector(self, text: str) -> list[float]:
        return unit(self.encoder([text])[0])

    def add(self, rows: DataFrame, kind: str = "semantic", importance: float = 0.7, op: str | None = None) -> int:
        """Stores rows (key, content, session_id, source) with their vectors and entities; returns how many.

        Left out are contents stored before, or twice in ``rows``, and those that a memory of the same
        type resembles by DUPLICATE: an episodic one within its session, any other anywhere (C16, C17).
        Rows without a vector are compared by content alone; frozen entities get no links. An addition that failed may be repeated
        with its ``op``: links are written before memories, and replace those of the attempt before.
        """
        hashed = rows.where("content <> ''").withColumn("content_hash", T.content_hash(F.col("content")))
        first = hashed.groupBy("content_hash").agg(F.min_by(F.struct("key", "content", "session_id", "source"), "key").alias("r")).select("content_hash", "r.*")
        new = first.join(self.memories().select("content_hash"), "content_hash", "left_anti")
        vectors = embed(new, "content_hash", "content", self.encoder)
        own = cut(new.join(vectors, "content_hash").withColumn("id", F.xxhash64("content_hash")))
        within = "session_id" if kind == "episodic" else None
        alike = M.near_duplicates(own.where(F.size("embedding") > 0), DUPLICATE, within).select("id")
        alike = alike.union(M.known_before(own, M.fitting(self.memories(), kind), DUPLICATE, within)).distinct()
        typed = P.remember(self.spark.createDataFrame([], MEMORY), own.join(alike, "id", "left_anti"), kind, importance)
        typed = cut(typed.withColumn("created_at", F.current_timestamp()).select(*self.memories().columns))
        n = typed.count()
        if n:
            op = op or f"w{uuid.uuid4().hex}"
            found = E.extract_entities(typed, "id", "content").select(F.col("id").alias("memory"), F.col("name").alias("entity"), "confidence")
            found = found.join(self.table("entity").where("is_frozen").select(F.col("name").alias("entity")), "entity", "left_anti")
            links = found.groupBy("memory", "entity").agg(F.max("confidence").alias("weight")).withColumn("created_at", F.current_timestamp())
            self.append("memory_entity", links, op)
            self.append("memory", typed, op)
        return n

    def store(self, content: str, kind: str = "semantic", importance: float = 0.7, session: str | None = None) -> int:
        """One memory; 0 if it is known already."""
        return self.add(self.spark.createDataFrame([(0, content, session, None)], "key long, content string, session_id string, source string"), kind, importance)

    def known_entities(self) -> DataFrame:
        """name and confidence of the entities that most memories are linked to (F2)."""
        return I.known_entities(self.table("memory_entity")).select(F.col("entity").alias("name"), "confidence")

    def search(self, query: str, top_k: int = 5, threshold: float = 0.6, session: str | None = None, model: Model | None = None, sure: float = SURE) -> DataFrame:
        """The tool of retrieval (L1): vector, graph and topic paths, merged, reranked and cut; each row found counts an access.

        Only active memories, of one session's if one is given; a blank query finds nothing. Entities of the query
        open the graph and topic paths if they are known, or found, with a confidence of ``sure``. With a model, the merged rows stand in
        the order that it gives (E2, E3).
        """
        held = M.fitting(self.memories(), session=session).where(F.size("embedding") > 0)
        none = held.limit(0).withColumn("score", F.lit(None).cast("double"))
        vector = self.vector(query) if query.strip() else []
        if not vector:
            return none
        said = E.extract_entities(self.spark.createDataFrame([(0, query)], "id long, t string"), "id", "t", self.known_entities())
        names = [r["name"] for r in said.where(F.col("confidence") >= sure).select("name").distinct().orderBy("name").collect()]
        ids = held.select(F.col("id").alias("memory"))
        edges = self.table("memory_entity").join(ids, "memory", "left_semi")
        links = self.table("topic_memory").join(ids, "memory", "left_semi")
        found = R.retrieve(held, edges, links, self.topics(), held, vector, query, names, names, top_k, threshold, model)
        rows = held.join(F.broadcast(found.select("id", "score")), "id").select(*held.columns, "score").collect()  # top_k at most
        if not rows:
            return none
        self.append("access", self.spark.createDataFrame([(r["id"],) for r in rows], "id long").withColumn("ts", F.current_timestamp()))
        return self.spark.createDataFrame(rows, none.schema).orderBy(F.desc("score"))

    def accesses(self) -> DataFrame:
        """How often each memory was found."""
        return self.table("access").groupBy("id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))

    def make_topics(self, split: int = I.SPLIT, near: float = 0.7, model: Model | None = None) -> int:
        """Topics for the entities of many links (K18, K19); returns the links made.

        Entities whose links are as they were keep their topics. A model, if one is given, names the topics from their memories.
        """
        held = self.memories().select("id", "embedding").where(F.size("embedding") > 0)
        edges = self.table("memory_entity")
        sizes = edges.groupBy("entity").agg(F.count_distinct("memory").alias("links")).where(F.col("links") >= split)
        known = self.table("topic").groupBy(F.col("parent").alias("entity")).agg(F.max("links").alias("known"))
        due = cut(sizes.join(known, "entity", "left").where(~F.col("links").eqNullSafe(F.col("known"))).select("entity", "links"))
        made = I.supernode_topics(edges.join(due, "entity", "left_semi"), held, split=split, near=near)
        links = cut(made.withColumn("id", F.xxhash64("entity", "topic", F.lit(uuid.uuid4().hex))))
        n = links.count()
        if n:
            topics = links.select(F.col("id").alias("topic"), F.col("topic").alias("name"), F.col("entity").alias("parent")).distinct().join(due.withColumnRenamed("entity", "parent"), "parent")
            if model:
                named = P.name_topics(links.where("topic <> 'Archive'").select(F.col("id").alias("cluster"), "memory"), self.memories(), model)
                topics = topics.join(named.select(F.col("cluster").alias("topic"), F.col("name").alias("said")), "topic", "left").withColumn("name", F.coalesce("said", "name"))
            # Links first: a topic that isn't there yet is nobody's parent. Topics made before for the same entities are told by ``current_topics``.
            op = f"w{uuid.uuid4().hex}"
            self.append("topic_memory", links.select(F.col("id").alias("topic"), "memory", "weight"), op)
            self.append("topic", topics.withColumn("created_at", F.current_timestamp()), op)
        return n

    def topics(self) -> DataFrame:
        """The topics made last for each entity."""
        held = self.table("topic", "op")
        last = held.groupBy("parent").agg(F.max_by("op", F.struct("created_at", "op")).alias("op"))
        return held.join(last, ["parent", "op"], "left_semi").drop("op")

    def import_state(self) -> DataFrame:
        """A row for each file, as it was told last."""
        return M.latest(self.table("document_import_state"), "file_path", F.desc("imported_at"), F.desc("file_hash"))

    def import_documents(self, folder: str, pdf=None) -> DataFrame:
        """Stores the chunks of a folder's files that are new or changed, and their state; returns path and error of each."""
        return self._import(files.read_documents(self.spark, folder, pdf), f"w{uuid.uuid4().hex}")

    def watch(self, folder: str, checkpoint: str, pdf=None) -> None:
        """Imports the files that have come to a folder since the stream last ran.

        Every trigger is one import, and its writes bear its number: a trigger that failed and is repeated stores nothing twice. A file
        that changes under its name is found by ``import_documents``, as the source tells files by their paths.
        """
        name = f"s{zlib.crc32(checkpoint.encode())}"

        def take(batch: DataFrame, number: int) -> None:
            self._import(files.parsed(batch, pdf), f"{name}-{number}")

        stream = messages.documents_stream(self.spark, folder).writeStream.foreachBatch(take)
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _import(self, read: DataFrame, op: str) -> DataFrame:
        """Stores what is new of the files (path, text, file_hash, error), then their states, under one name of the write."""
        done = self.import_state().where("status <> 'error'")
        new = cut(M.changed_files(read, done))
        parts = cut(D.split_by_topic(new.select(F.xxhash64("path").alias("doc_id"), "text")))
        self._store_chunks(parts, new.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source")), "doc:", op=op)
        counts = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        ok = F.col("error").isNull()
        state = new.withColumn("doc_id", F.xxhash64("path")).join(counts, "doc_id", "left")
        self.append("document_import_state", state.select(
            F.col("path").alias("file_path"), "file_hash", F.current_timestamp().alias("imported_at"), F.coalesce("n", F.lit(0)).alias("chunks_count"),
            ok.alias("entities_extracted"), ok.alias("relations_extracted"), F.when(ok, "completed").otherwise("error").alias("status"), "error",
        ), op)
        return new.select("path", "error")

    def import_pages(self, pages: DataFrame, session: str | None = None) -> int:
        """Stores the chunks of pages (url, html); returns how many (A17, A33). Pages are fetched by whoever gives them."""
        texts = pages.select(F.xxhash64("url").alias("doc_id"), F.col("url").alias("source"), T.html_to_text(F.col("html")).alias("text"))
        return self._store_chunks(D.split_by_topic(texts), texts, "url:", session)

    def _store_chunks(self, parts: DataFrame, sources: DataFrame, prefix: str, session: str | None = None, op: str | None = None) -> int:
        rows = parts.join(sources.select("doc_id", "source").distinct(), "doc_id")
        return self.add(rows.select(F.struct("doc_id", "chunk").alias("key"), "content", F.lit(session).cast("string").alias("session_id"), F.concat(F.lit(prefix), "source").alias("source")), op=op)

    def import_terms(self, docs: DataFrame, settings: TI.Settings = TI.SETTINGS, cache: DataFrame | None = None) -> DataFrame:
        """Finds and stores the terms of documents (doc, text) that are new or changed; returns their counts, a row a document.

        A document's rows belong to the run that its row of ``term_document`` names, which is written after them; so an import that failed
        is as if it hadn't been, and one that is repeated changes nothing.
        """
        hashed = docs.select(F.col("doc").cast("string"), "text", F.md5("text").alias("content_hash")).dropDuplicates(["doc"])
        known = self._term_documents().select("doc", F.col("content_hash").alias("known"), F.lit(True).alias("held"))
        new = cut(hashed.join(known, "doc", "left").where(F.col("held").isNull() | ~F.col("content_hash").eqNullSafe(F.col("known"))).select("doc", "text", "content_hash"))
        parts = D.split_by_topic(new.select(F.xxhash64("doc").alias("doc_id"), "text"))
        blocks = parts.join(new.select(F.xxhash64("doc").alias("doc_id"), "doc"), "doc_id").select("doc", F.col("chunk").alias("block"), F.col("content").alias("text"))
        empty = new.where("text IS NULL OR text = ''").select("doc", F.lit(0).alias("block"), "text")
        found = TI.import_terms(blocks.unionByName(empty), settings, cache)
        run = f"w{uuid.uuid4().hex}"
        self.append("term_block", found.rows.withColumn("run", F.lit(run)), run)
        self.append("term_document", new.select("doc", "content_hash", F.current_timestamp().alias("imported_at"), F.lit(run).alias("run")), run)
        return found.counts()

    def _term_documents(self) -> DataFrame:
        return M.latest(self.table("term_document"), "doc", F.desc("imported_at"), F.desc("run"))

    def terms(self) -> TI.Imported:
        """All terms imported, of each document those of its last import: stored terms, relations, counts."""
        return TI.Imported(self.table("term_block").join(self._term_documents().select("doc", "run"), ["doc", "run"], "left_semi").drop("run"))

    def compile(self, folder: str, model: Model, kind: str, version: str, pdf=None, done: Callable[[dict], None] | None = None) -> dict:
        """Compiles a folder's documents into blocks of triples, a summary and a topic (K37); blocks compiled before only count as skipped.

        Documents of up to LARGE characters are split by their sections, larger ones by topic. Returns the
        numbers of blocks, stored, skipped and failed ones and of triples, which ``done`` is told too (M3). What the writing job
        stores is counted by that job (D21-D23).
        """
        docs = files.read_documents(self.spark, folder, pdf).where("text IS NOT NULL").select(F.xxhash64("path").alias("doc_id"), "text")
        small = D.smart_split(docs.where(F.length("text") <= LARGE)).select("doc_id", "block", "content")
        large = D.split_by_topic(docs.where(F.length("text") > LARGE), 1500).select("doc_id", F.col("chunk").alias("block"), "content")
        block = F.concat_ws(":", F.col("doc_id").cast("string"), F.lpad(F.col("block").cast("string"), 8, "0"))
        blocks = cut(small.union(large).select(block.alias("block_id"), F.col("content").alias("text"), F.lit(f"{kind}:{version}").alias("doc_version")))
        known = cut(self.table("compiled").select("content_hash").distinct())
        hashed = blocks.select(T.content_hash(F.col("text")).alias("content_hash"))
        held = known.withColumn("held", F.lit(True))
        row = hashed.join(held, "content_hash", "left").agg(F.count(F.lit(1)).alias("total"), F.count("held").alias("skipped"), F.count_distinct("content_hash").alias("different")).first()
        stored, _ = P.compile_blocks(blocks, known, model, self.encoder)
        seen = Observation("compiled")
        counted = stored.observe(seen, F.count(F.lit(1)).alias("stored"), F.coalesce(F.sum(F.size("triples")), F.lit(0)).alias("triples"))
        self.append("compiled", counted)
        made, twice = seen.get, row["total"] - row["different"]
        told = {"total": row["total"], "stored": made["stored"], "skipped": row["skipped"] + twice, "failed": max(0, row["total"] - row["skipped"] - twice - made["stored"]), "triples": made["triples"]}
        if done:
            done(told)
        return told

    def maintain(self, at: str | None = None, days: int = 90, least: int = 10) -> dict:
        """Ages, promotes and expires memories, and freezes entities of very many links (K8, K11, K21, K22); returns how many of each.

        Only writes that hold a changed memory are written anew, from a copy that is complete before the first is replaced;
        a run that was interrupted while it replaced them is finished by the next. A second run at the same time changes nothing.
        """
        staged = f"{self.folder}/staging"
        if self._phase() == "staged":
            self._replace(staged)
        now = F.lit(at).cast("timestamp") if at else F.current_timestamp()
        found = cut(M.maintained(self.table("memory", "op"), self.accesses(), now, days, least))
        told = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
        touched = found.where("change <> 'kept'").select("op").distinct()
        kept = found.join(touched, "op", "left_semi")
        if told.keys() - {"kept"}:
            kept.withColumn("gone", F.col("change") == "deleted").drop("change").write.mode("overwrite").parquet(staged)
            self._phase("staged")
            self._replace(staged)
        due = G.degrees(self.table("memory_entity")).where("frozen").select(F.col("entity").alias("name"))
        due = due.join(self.table("entity").where("is_frozen"), "name", "left_anti")
        frozen = Observation("frozen")
        rows = due.select("name", F.lit(True).alias("is_frozen"), F.lit("links").alias("freeze_reason"), now.alias("frozen_at"))
        self.append("entity", rows.observe(frozen, F.count(F.lit(1)).alias("n")))
        return {"changed": told.get("changed", 0), "deleted": told.get("deleted", 0), "frozen": frozen.get["n"]}

    def _phase(self, put: str | None = None) -> str | None:
        """How far maintenance came, or sets it."""
        path = f"{self.folder}/maintenance"
        if put is not None:
            self.spark.createDataFrame([(put,)], "phase string").coalesce(1).write.mode("overwrite").parquet(path)
            return put
        try:
            row = self.spark.read.schema("phase string").parquet(path).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return row["phase"] if row else None

    def _replace(self, staged: str) -> None:
        """Puts the staged rows in the place of the writes that they are copies of; done twice it does the same."""
        rows = self.spark.read.schema(f"{MEMORY}, op string, gone boolean").parquet(staged)
        left = rows.where("NOT gone").drop("gone")
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("op").parquet(f"{self.folder}/memory")
        emptied = rows.groupBy("op").agg(F.bool_and("gone").alias("empty")).where("empty").select("op")
        for r in emptied.toLocalIterator():  # a write of which nothing is left
            self.append("memory", self.spark.createDataFrame([], MEMORY), r["op"])
        self._phase("done")

    def list(self, most: int = 20) -> DataFrame:
        """The latest memories."""
        return R.top(self.memories(), most, F.desc("created_at"), F.asc("id")).select("id", "type", "content", "importance", "created_at")

    def stats(self) -> DataFrame:
        """Memories by type, and how many are active."""
        return self.memories().groupBy("type").agg(F.count(F.lit(1)).alias("memories"), F.count(F.when(F.col("is_active"), 1)).alias("active"))

    def status(self) -> dict:
        """Whether there are memories, and the size of their vectors."""
        row = self.memories().select(F.size("embedding").alias("n")).first()
        return {"folder": self.folder, "ready": row is not None, "dimensions": row["n"] if row else None}


def extract_terms(spark: SparkSession, text: str, most: int = 200) -> DataFrame:
    """The best terms of one text."""
    docs = spark.createDataFrame([(zlib.crc32(text.encode()), text)], "doc_id long, text string")
    return X.scored_terms(docs, least=1, best=most)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("command", choices=["store", "search", "list", "stats", "import", "terms"])
    parser.add_argument("text", nargs="?", default="")
    parser.add_argument("--folder", default=os.path.join(os.getcwd(), "memories"))
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--threshold", type=float, default=0.6)
    parser.add_argument("--session")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"palimpsest-{uuid.uuid4().hex[:8]}").getOrCreate()
    engine = Engine(spark, given.folder)
    if given.command == "store":
        engine.store(given.text, session=given.session)
    elif given.command == "search":
        engine.search(given.text, given.top_k, given.threshold, given.session).select("id", "type", "content", "score").show(given.top_k, False)
    elif given.command == "import":
        engine.import_documents(given.text).show(100, False)
    elif given.command == "terms":
        extract_terms(spark, given.text).show(50, False)
    else:
        (engine.list() if given.command == "list" else engine.stats()).show(100, False)
