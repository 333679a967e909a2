"""Entities, models' answers, the steps around models, and the engine as one object."""

import re

from pyspark.sql import functions as F

from palimpsest import engine
from palimpsest.functions import answers, entities
from palimpsest.operators import memories
from palimpsest.sources.models import hashed_encoder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_every_kind_begins_with_letters():
    for pattern in entities.KINDS.values():
        assert all(re.match("[a-z]", p) for p in pattern.split("|")) and "(" not in pattern


def test_entities_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "TS ts typescript xts ts_ é-ts"), (4, "c++x c++ C#y"), (5, "git " * 50_000)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["name"], r["entity_type"], r["original"]) for r in entities.extract_entities(docs, "doc_id", "text").collect())
    assert found == [(3, "TypeScript", "language", "TS"), (4, "C#", "language", "C#"), (4, "C++", "language", "c++"), (5, "Git", "tool", "git")]
    assert entities.extract_entities(docs.limit(0), "doc_id", "text", docs.select(F.lit("a").alias("name"), F.lit(1.0).alias("confidence"))).count() == 0


def test_a_model_names_what_patterns_do_not(spark):
    docs = spark.createDataFrame([(1, "uses git"), (2, "a talk"), (3, None)], "doc_id long, text string")
    found = memories.entities_or_model(docs, "doc_id", "text", lambda prompts: ['{"entities": [{"name": "k8s"}]}' for _ in prompts])
    assert sorted((r["doc_id"], r["name"], r["source"], r["entity_type"]) for r in found.collect()) == [(1, "Git", "regex", "tool"), (2, "Kubernetes", "model", None)]


def test_answers_that_cannot_be_read(spark):
    for said in (F.lit(None).cast("string"), F.lit(""), F.lit("{"), F.lit("[]"), F.lit("---TOPIC---")):
        assert one(spark, answers.clusters(said)) == []
        assert one(spark, answers.merged(said))["confidence"] == 0
        assert one(spark, answers.profile(said)).asDict() == {"likes": [], "dislikes": [], "facts": {}, "habits": []}
        assert [b.asDict() for b in one(spark, answers.batch(said, F.lit(2)))] == [{"triples": [], "summary": ""}] * 2
        assert one(spark, answers.block(said)).asDict() == {"triples": [], "summary": "", "topic": ""}
    assert one(spark, entities.answered_entities(F.lit(None).cast("string"))) == []


def test_block_is_clipped(spark):
    said = one(spark, answers.block(F.lit("---TRIPLES---\n" + "a|b|c\n" * 30 + "---SUMMARY---\n" + "x" * 400 + "\n---TOPIC---\n" + "t" * 60)))
    assert len(said["triples"]) == 20 and len(said["summary"]) == 300 and len(said["topic"]) == 50


def test_clusters_and_merges_of_models(spark):
    rows = spark.createDataFrame([(i, f"note {i} of UserService" if i else None) for i in range(30)], "id long, content string")
    model = lambda prompts: ['{"clusters": [{"theme": "t", "memory_indices": [0, 3, 99]}, {"theme": "u", "memory_indices": [4]}]}' for _ in prompts]
    found = sorted(map(tuple, memories.model_clusters(rows, model).collect()))
    assert found == [(0, "t", 0), (0, "t", 3)]
    assert memories.model_clusters(rows.limit(4), model).count() == 0
    held = spark.createDataFrame([(1, 5), *[(2, i) for i in range(30)]], "cluster long, memory long")
    merge = lambda prompts: ['{"merged_content": "%d", "confidence": 0.7}' % p.count("\n[") for p in prompts]
    merged = {r["cluster"]: r for r in memories.merge_clusters(held, rows, merge).collect()}
    assert merged[1]["content"] == "note 5 of UserService" and merged[1]["entities"] == ["UserService"] and merged[1]["accepted"]
    assert merged[2]["content"] == "19" and not merged[2]["accepted"]


def test_blocks_of_one_content_are_compiled_once(spark):
    blocks = spark.createDataFrame([(3, "Same  text", "v2"), (1, "same text", "v1"), (2, None, "v1"), (4, "held", "v3"), (5, "no use", "v3")], "block_id long, text string, doc_version string")
    known = blocks.where("block_id = 4").select(memories.T.content_hash(F.col("text")).alias("content_hash"))
    model = lambda prompts: ["" if "no" in p else "---TRIPLES---\nblock|is|thing\n---SUMMARY---\nsummary of it" for p in prompts]
    stored, references = memories.compile_blocks(blocks, known, model, hashed_encoder(8))
    assert [(r["block_id"], r["doc_version"], r["content"]) for r in stored.collect()] == [(1, "v1", "summary of it")]
    assert sorted((r["doc_versions"], r["ref_count"]) for r in references.collect()) == [(["v1", "v2"], 2), (["v3"], 1)]


def test_reflections_hold_related_memories(spark):
    rows = [(1, "reflection", "alpha beta gamma delta", 0.9), (2, "semantic", "alpha beta gamma epsilon", 0.8), (3, "semantic", "alpha omega", 0.9), (4, "semantic", "alpha beta gamma delta", 0.9), (5, "episodic", None, 0.7), (6, "episodic", "x", None)]
    table = spark.createDataFrame(rows, "id long, type string, content string, similarity double").withColumn("importance", F.lit(0.5))
    found = {r["id"]: (r["level"], [c["id"] for c in r["children"] or []]) for r in memories.hierarchy(table).collect()}
    assert found == {1: (3, [2]), 2: (2, []), 3: (2, []), 4: (2, []), 5: (1, [])}


def test_the_engine_stores_finds_and_imports(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "store"))
    assert not e.healthy() and e.search("red").count() == 0 and e.status()["ready"] is False
    e.create()
    assert e.healthy()
    assert e.store("red apples taste sweet", session="s") == 1
    assert e.store("Red apples  taste sweet") == 0 and e.store("sweet red apples taste") == 0  # the same, and one of equal vector
    assert e.store("sweet apples red taste", "episodic", session="s") == 1 and e.store("apples red sweet taste", "episodic", session="s") == 0
    assert e.store("apples red sweet taste", "episodic", session="other") == 1
    e.store("PostgreSQL runs on Linux")
    found = [r["content"] for r in e.search("what of red apples", threshold=0.9).collect()]
    assert "red apples taste sweet" in found
    assert [r["content"] for r in e.search("tell me of PostgreSQL please", top_k=1).collect()] == ["PostgreSQL runs on Linux"]
    assert e.search("the sea far away", session="nobody").count() == 0 and e.search(" ").count() == 0
    assert e.accesses().agg(F.sum("access_count")).first()[0] >= 2
    (tmp_path / "a.md").write_text("# Title\n\ngreen hills rise far away")
    assert [r["error"] for r in e.import_documents(str(tmp_path)).collect()] == [None]
    assert e.import_documents(str(tmp_path)).count() == 0
    (tmp_path / "a.md").write_text("# Title\n\nblue hills rise far away, and higher")
    assert e.import_documents(str(tmp_path)).count() == 1 and e.table("document_import_state").count() == 2
    pages = spark.createDataFrame([("http://x/y", "<p>yellow birds sing at dawn</p>")], "url string, html string")
    assert e.import_pages(pages) == 1 and e.import_pages(pages) == 0
    assert e.status()["dimensions"] == 64 and e.list().count() >= 6
    model = lambda prompts: ["---TRIPLES---\nhills | rise | away\n---SUMMARY---\nhills that rise far away\n---TOPIC---\nland" for _ in prompts]
    (tmp_path / "b.md").write_text("# One\n" + "words of a section that is long enough to be a block. " * 4)
    told = e.compile(str(tmp_path), model, "notes", "1")
    assert told["stored"] == told["total"] - told["skipped"] >= 1 and told["triples"] >= 1
    assert e.compile(str(tmp_path), model, "notes", "1")["stored"] == 0
    assert "UserService" in {r["term"] for r in engine.extract_terms(spark, "The UserService calls UserService").collect()}


def test_topics_of_entities_with_many_links(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "store"))
    rows = [(i, f"Redis {'kernel modules' if i % 2 else 'desktop themes'} note{i}", None, None) for i in range(12)]
    assert e.add(spark.createDataFrame(rows, "key long, content string, session_id string, source string")) == 12
    assert e.make_topics(split=5, near=0.6) == 12
    assert {r["name"] for r in e.table("topic").collect()} >= {"Topic 1", "Topic 2"}
    assert e.search("anything about Redis kernel", top_k=3, threshold=0.5).count() == 3
