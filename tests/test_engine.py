"""The engine's queries against their SQL, and its streams, sources and folds."""

import os
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scores, texts
from palimpsest.operators import cache, documents, graph, indexing, memories, search, store, terms
from palimpsest.plans.queries import ORACLE_SQL, QUERIES
from palimpsest.sources import files
from palimpsest.streaming import messages

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda x: tuple(x) if isinstance(x, (list, np.ndarray)) else x)
    return sorted(map(tuple, frame.astype(str).values.tolist()))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_agrees_with_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_extracted_terms_are_rows(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    wanted = sorted((r.doc_id, t, n) for r in texts for t, n in terms.grams(r.text or "").items() if n >= 3 and 3 <= len(t) <= 50)
    assert sorted(tuple(r) for r in QUERIES["extracted_terms"](spark, FOLDER).select("doc_id", "term", "freq").collect()) == wanted


def test_terms_leave_a_task_in_short_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(terms, "TOLD", 50)
    texts_ = [f"alpha-{chr(97 + i)}x BETA GammaDelta some plain words follow here {'pg_x ' * i}" for i in range(20)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array(texts_)], ["doc_id", "text"])
    found = list(terms._told([batch, batch], lambda t: list(terms.grams(t).items()), [("term", pa.string()), ("freq", pa.int64())]))
    most = max(len(terms.grams(t or "")) for t in texts_)
    assert len(found) > 2 and all(b.num_rows < 50 + most for b in found)
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == [(i, *kv) for _ in range(2) for i, t in enumerate(texts_) for kv in terms.grams(t or "").items()]


def test_hierarchy_compares_repeated_texts_once_and_keeps_all_memories(spark):
    told = ["alpha beta1 gamma delta", "alpha beta1 gamma other", "alpha beta1 gamma delta", "alpha lone1 lone2 lone3", None, ""]
    rows = [(k * 10 + i, kind, t, 0.5, 0.9) for k, kind in enumerate(["reflection", "semantic", "episodic"]) for i, t in enumerate(told)]
    found = memories.hierarchy(spark.createDataFrame(rows, "id long, type string, content string, importance double, similarity double"))
    sets = [set((t or "").split()) for t in told]
    near = lambda i: [10 + j for j in range(6) if told[i] != told[j] and sets[i] | sets[j] and len(sets[i] & sets[j]) > 0.5 * len(sets[i] | sets[j])]
    held = {r["id"]: [c["id"] for c in r["children"] or []] for r in found.collect()}
    assert held == {r[0]: near(r[0]) if r[0] < 10 else [] for r in rows} and held[0] == [11] and held[1] == [10, 12]


def test_chunks_keep_every_word():
    text = "\n\n".join(" ".join(f"w{i}-{j}." for j in range(n)) for i, n in enumerate([3, 400, 1, 50, 2]))
    parts = documents.chunk_text(text, 200)
    assert " ".join(parts).split() == text.split() and max(map(len, parts)) <= 300


def test_context_windows_join_what_touches(spark):
    text = "a" * 300 + "KEY" + "b" * 50 + "key" + "c" * 500 + "key"
    df = spark.createDataFrame([(1, text), (2, "none" * 100)], "doc_id long, text string")
    found = sorted(tuple(r) for r in documents.context_windows(df, "key").collect())
    assert found == [(1, 1, 200, 456), (1, 2, 756, 859), (2, 1, 0, 200)]


def test_merges_and_patches(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, x string, y int")
    up = store.upsert(base, spark.createDataFrame([(2, "c", 7), (3, "d", 8)], "id long, x string, y int"), "id")
    assert sorted(map(tuple, up.collect())) == [(1, "a", 5), (2, "c", 7), (3, "d", 8)]
    patched = store.patch(base, spark.createDataFrame([(1, None, 9)], "id long, x string, y int"), "id")
    assert sorted(map(tuple, patched.collect())) == [(1, "a", 9), (2, "b", 6)]


def test_alias_circles_resolve_to_nothing(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 1)], "alias long, target long")
    assert {r[0]: r[1] for r in graph.resolve_aliases(df).collect()} == {1: 3, 2: 3, 7: 3, 5: None, 6: None}


@pytest.mark.parametrize(("size", "block"), [(1100, {}), (40, {"block": 7})])
def test_cooccurrence_pairs_large_memories(spark, size, block):
    own = {1: range(size), 2: range(0, size, 9), 3: range(5), 4: [7]}
    df = spark.createDataFrame([(m, e) for m, es in own.items() for e in es] + [(3, 1), (None, 2), (2, None)], "memory long, entity long")
    expected, mentions = {}, {}
    for es in [*map(list, own.values()), [2]]:
        for k, a in enumerate(es):
            mentions[a] = mentions.get(a, 0) + 1
            if es != [2]:
                for b in es[k + 1 :]:
                    expected[a, b] = expected.get((a, b), 0) + 1
    expected = {p: n for p, n in expected.items() if n >= 2}
    found = graph.cooccurrence(df, 2, **block).collect()
    assert {(r["in"], r["out"]): r["n"] for r in found} == expected and len(found) == len(expected)
    assert all(abs(r["weight"] - r["n"] / (mentions[r["in"]] * mentions[r["out"]]) ** 0.5) < 1e-12 for r in found)


def test_expressions(spark):
    row = spark.range(1).select(
        scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        texts.conflicting(F.lit("Ann works at Foo"), F.lit("Ann works at Bar")).alias("work"),
        texts.conflicting(F.lit("she likes tea"), F.lit("she likes coffee")).alias("like"),
        texts.repetitive(F.lit("ab ab ab ab ab")).alias("again"),
        store.record_id(F.lit("memory:42")).alias("id"), store.record_id(F.lit("memory:x")).alias("none"),
        files.model_json(F.lit('```json\n{"a": 3,}\n```'), "a int").alias("j"),
    ).first()
    assert row["zero"] == 0 and row["work"] and not row["like"] and row["again"] and row["id"] == 42 and row["none"] is None and row["j"]["a"] == 3


def test_term_filter(spark):
    df = spark.createDataFrame([("pg_dump", 1.0), ("write-ahead", 1.0), ("FooFooFoo", 1.0), ("BufferPool", 1.0), ("WAL", 2.5), ("index scan", 3.5), ("red house", 9.0)], "term string, score double")
    found = {r["term"]: r["confidence"] for r in terms.filter_terms(df, "database", ["index", "ahead"]).collect()}
    assert found == {"pg_dump": 0.95, "write-ahead": 0.75, "BufferPool": 0.85, "WAL": 0.7, "index scan": 0.6}


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = messages.event_stream(spark, str(tmp_path / "in"), events.schema)
    messages.run_available(messages.mention_counts(stream, "user_id"), str(tmp_path / "out"), str(tmp_path / "state"))
    out = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in messages.mention_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id").collect()}
    assert out and out <= batch and len(out) >= 0.9 * len(batch)  # the last windows stay open


def test_documents_of_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title")
    (tmp_path / "c.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert found == {"a.md": "# Title", "b.docx": "one\n\ntwo"}


def test_diversity_penalties(spark):
    df = spark.createDataFrame([(1, 9.0, "alpha beta gamma delta", "x"), (2, 8.0, "alpha beta gamma delta", "x"), (3, 7.0, "other words entirely here", None)], "id long, score double, content string, cluster string")
    found = {r["id"]: round(r["score"], 6) for r in search.rerank(df).collect()}
    assert found == {1: 1.0, 2: 0.6, 3: 0.9}


def test_model_answers(spark):
    from palimpsest.functions import answers

    said = "---三元组---\nWAL | protects | data\nWAL | holds | a|b\naa aa aa aa | is | x1\nno triple\n---SUMMARY---\nshort\nthe log of changes\n---TOPIC---\nstorage"
    frame = spark.createDataFrame([(said,), ("",), (None,)], "a string").select(answers.sectioned(F.col("a")).alias("s"), answers.ranking(F.col("a"), 3).alias("r")).collect()
    assert [tuple(t) for t in frame[0].s.triples] == [("WAL", "protects", "data"), ("WAL", "holds", "a|b")]
    assert (frame[0].s.summary, frame[0].s.topic) == ("the log of changes", "storage")
    assert all((x.s.triples, x.s.summary, x.s.topic, x.r) == ([], "", "", [0, 1, 2]) for x in frame[1:])
    told = spark.createDataFrame([("2 2 9 99999999999999999999 0",)], "a string").select(answers.ranking(F.col("a"), 4).alias("r")).first()
    assert told.r == [2, 0, 1, 3]


def test_encoders_and_models(spark):
    from palimpsest.sources import models

    frame = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "a b")], "id long, t string")
    got = {r.id: r.embedding for r in models.embed(frame, "id", "t", models.hashed_encoder(8), "query").collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    told = {r.id: r.answer for r in models.complete(frame, "id", "t", lambda prompts: [p.upper() for p in prompts]).collect()}
    assert told == {1: "A B", 2: "", 3: None, 4: "A B"}
    assert models.unit([[3.0, 4.0]]) == [0.6, 0.8] and models.unit([0.0]) == [] and models.unit([float("nan")]) == []


def test_sections_and_pieces(spark):
    frame = spark.createDataFrame([(1, "before\n# A\nx\n## B \ny"), (2, ""), (3, None)], "doc_id long, text string")
    got = documents.sections(frame).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.title, r.content) for r in got] == [(1, None, "before\n"), (1, "A", "# A\nx\n"), (1, "B", "## B \ny")]
    pieces = documents.fixed_pieces(frame, 8, 3).orderBy("piece").collect()
    assert [(r.piece, r.content) for r in pieces] == [(0, "before\n#"), (1, "A\nx\n##"), (2, "B \ny")]


def test_splitting_keeps_words_and_sizes():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    paragraphs = [" ".join(word() + ("." if rng.random() < 0.2 else "") for _ in range(rng.integers(1, 160))) for _ in range(30)]
    text = "\n\n".join(paragraphs)
    parts = documents.topic_chunks(text, 300)
    assert " ".join(c for c, _ in parts).split() == text.split()
    longest = max(len(s) for p in paragraphs for s in documents._SENTENCE.split(p))
    assert max(len(c) for c, _ in parts) <= max(540, longest) and {k for _, k in parts} <= {"semantic", "sentence", "paragraph"}
    # Groups against their definition.
    groups = documents.topic_groups(paragraphs, 450)
    assert [p for g in groups for p in g] == paragraphs
    for a, b in zip(groups, groups[1:]):
        assert documents.shifts(a[-1], b[0]) or sum(map(len, a)) + len(b[0]) > 450
    for g in groups:
        assert len(g) == 1 or sum(map(len, g)) <= 450 and not any(documents.shifts(x, y) for x, y in zip(g, g[1:]))


def test_smart_blocks():
    body = "Some words of a section. " * 8
    text = f"intro\n# One\n{body}\n\n{body}\n## Two\nshort\n# Three\n" + (body + "\n\n") * 14
    blocks = documents.section_blocks(text, 2000, 100)
    assert [t for t, _, _ in blocks] == ["One", "Three", "Three"] and max(len(c) for *_, c in blocks) <= 2000
    assert documents.sections_of("a\n# B c\n### D")[1] == ("D", 3, 8, 13)
    assert documents.smart_blocks(text) == blocks and documents.smart_blocks("plain words " * 400)[0][0] is None
    said = documents.said_structure("---DOCTYPE---\nmanual\n---SECTIONS---\nA|2|0\nB|x\n---SEMANTIC---\nconcept|note\nother|x", "")
    assert said == {"doc_type": "manual", "sections": [("A", 2), ("B", 1)], "units": [("concept", "note")]}
    units = documents.semantic_units(f"# H\n\n{body}\n\n1. {body}\n\n# I\n\n例如 {body}")
    assert [(t, k) for t, k, _ in units] == [("H", "procedure"), ("I", "example")]


def test_upserts_take_one_row_a_key(spark):
    base = spark.createDataFrame([(1, "a", 5)], "id long, x string, place int")
    twice = spark.createDataFrame([(1, "b", 6), (1, "c", 7), (2, "d", 8), (2, "d", 8)], "id long, x string, place int")
    assert sorted(map(tuple, store.upsert(base, twice, "id", F.desc("place")).collect())) == [(1, "c", 7), (2, "d", 8)]
    assert sorted(map(tuple, store.patch(base, twice, "id", F.asc("place")).collect())) == [(1, "b", 6)]
    dated = store.patch(base.withColumn("updated_at", F.lit(0)), twice.select("id", "x"), "id", F.asc("x"), at=F.lit(9)).first()
    assert tuple(dated) == (1, "b", 5, 9)


def test_snippets_and_topics_of_entities(spark):
    relations = spark.createDataFrame([(1, 2, [10, 11, 12, 13, 10]), (1, 3, [14])], "in long, out long, evidence_memory_ids array<long>")
    rows = [(10 + i, f"{'x' * 150}Ann met Bob in year {i}{'y' * 150}", i) for i in range(4)] + [(14, "nobody here", 1)]
    held = spark.createDataFrame(rows, "id long, content string, created_at int")
    names = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "eve")], "id long, name string")
    found = {(r["in"], r["out"]): r["snippets"] for r in indexing.snippets(relations, held, names).collect()}
    first = found[1, 2].split(" | ")
    assert len(first) == 3 and first[0] == "x" * 100 + "Ann met Bob in year 0" + "y" * 82 and found[1, 3] == "nobody here"
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10)] + [(10, [-1.0, -1.0])], "id long, embedding array<double>")
    edges = spark.createDataFrame([(i, 7, 1.0 - i / 100) for i in range(11)] + [(1, 8, 1.0)], "memory long, entity long, weight double")
    topics = indexing.supernode_topics(edges, vectors, split=5)
    got = {r["memory"]: (r["entity"], r["topic"], r["weight"]) for r in topics.collect()}
    assert got[0] == (7, "Topic 1", 0.8) and got[1] == (7, "Topic 2", 0.8) and got[10][1] == "Topic 3" and len(got) == 11


def test_term_cache_round_trip(spark, tmp_path):
    one = spark.createDataFrame([("WAL", "concept"), ("MVCC", "concept")], "term string, type string")
    held = cache.put(spark.createDataFrame([], cache.TERMS), cache.seeds(one, "database", F.lit("2024-01-01").cast("timestamp")))
    cache.write_json(held, str(tmp_path / "terms"))
    assert sorted(map(tuple, cache.read_json(spark, str(tmp_path / "terms")).collect())) == sorted(map(tuple, held.collect()))
    asked = spark.createDataFrame([("database", "wal"), ("database", "wal"), ("ai", "wal")], "domain string, normalized string")
    assert {r["term"]: r["hit_count"] for r in cache.hits(held, asked).collect()} == {"WAL": 2, "MVCC": 0}
    assert tuple(cache.stats(cache.lookup(held, asked)).first()) == (2, 1, 2 / 3)


def test_settings_funnel_and_many_topics(spark):
    merged = terms.merge_settings({"domain": "a", "roots": ["x"], "prompt": ""}, {"domain": "b", "roots": ["y"], "prompt": "p", "whitelist": ["w"]})
    assert merged["domain"] == "a" and merged["roots"] == ["x", "y"] and merged["prompt"] == "p" and merged["whitelist"] == ["w"]
    path = lambda *s: spark.createDataFrame([(float(x),) for x in s], "score double")
    assert tuple(search.funnel(path(1, 2), path(), path(1), path(1, 3)).first()) == (2, 0, 1, 2, 2.0)
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "id long, embedding array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "topic long, centroid array<double>")
    few, many = (sorted(map(tuple, graph.mount(v, c, 0.1, most).collect())) for most in (1000, 5))
    assert [x[:2] for x in few] == [x[:2] for x in many] and len(few) == 30


def test_two_degree_retrieval_adds_memories(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(6)], "id long, embedding array<double>")
    edges = spark.createDataFrame([(10, "a", 0.9), (10, "b", 0.5), (11, "c", 0.95)], "memory long, entity string, weight double")
    relations = spark.createDataFrame([("b", "c", 0.5)], "in string, out string, weight double")
    contents = spark.createDataFrame([(i, f"content number {i}") for i in [*range(6), 10, 11]], "id long, content string")
    run = lambda degree: {r["id"] for r in search.retrieve_multi_degree(v, edges, relations, contents, [1.0, 0.0], ["a"], 20, 0.0, degree).collect()}
    assert run(1) == {*range(6), 10} and run(2) == {*range(6), 10, 11}
