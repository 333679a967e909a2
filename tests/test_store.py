"""The engine's store: repeated and interrupted writes, documents as a stream, terms, maintenance, retrieval by a model."""

import pytest
from pyspark.sql import functions as F

from palimpsest import engine
from palimpsest.operators import components, graph, search, similar, store, term_import, terms

ROWS = "key long, content string, session_id string, source string"


class Killed(Exception):
    pass


def killing(e, name, monkeypatch):
    """Makes the engine fail at its next write of a table, once."""
    real, left = e.append, [1]

    def append(table, rows, op=None):
        if table == name and left:
            left.pop()
            raise Killed(name)
        real(table, rows, op)

    monkeypatch.setattr(e, "append", append)


def contents(e):
    return sorted(r["content"] for r in e.memories().collect())


def links(e):
    return sorted(map(tuple, e.table("memory_entity").select("memory", "entity").collect()))


@pytest.mark.parametrize("name", ["memory", "document_import_state"])
def test_a_trigger_that_failed_stores_nothing_twice(spark, tmp_path, monkeypatch, name):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# One\n\nRedis holds keys of many kinds, as the notes say")
    (folder / "b.md").write_text("# Two\n\nPostgreSQL runs on Linux, and Docker is there")
    (folder / "bad.pdf").write_bytes(b"x")
    e = engine.Engine(spark, str(tmp_path / "store"))
    killing(e, name, monkeypatch)
    with pytest.raises(Exception):
        e.watch(str(folder), str(tmp_path / "checkpoint"))
    e.watch(str(folder), str(tmp_path / "checkpoint"))
    assert len(contents(e)) == len(set(contents(e))) == 2 and len(links(e)) == len(set(links(e))) > 0
    state = {r["file_path"][-5:]: (r["status"], r["chunks_count"]) for r in e.import_state().collect()}
    assert state == {"/a.md": ("completed", 1), "/b.md": ("completed", 1), "d.pdf": ("error", 0)}
    if name == "memory":
        return
    (folder / "c.md").write_text("# Three\n\nthe third of all the notes, that came late")
    e.watch(str(folder), str(tmp_path / "checkpoint"))
    assert len(contents(e)) == 3 and e.import_state().count() == 4
    (folder / "a.md").write_text("# One\n\nanother text altogether, of other words than before")
    assert [r["error"] for r in e.import_documents(str(folder)).where("path LIKE '%.md'").collect()] == [None]
    assert len(contents(e)) == 4 and e.import_state().count() == 4  # a row a file, whatever was written


TERMS = [
    ("a", "The BufferPool and the WAL of PostgreSQL: BufferPool, WAL, pg_dump and pg_dump. The hash-join of mysql, a hash-join.\n\nThe BufferPool again: WAL, WAL, BufferPool"),
    ("b", "BufferPool and WAL, BufferPool and WAL; redis and postgres with pg_restore, pg_restore"),
    ("c", "BufferPool with WAL; BufferPool without WAL. mysql"), ("d", None), ("e", ""),
]


def snapshot(found):
    return [sorted(map(str, df.collect())) for df in (found.stored(), found.relations(), found.counts(), found.by_domain(), found.errors())]


def test_an_import_of_terms_done_twice_changes_nothing(spark, tmp_path, monkeypatch):
    e = engine.Engine(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame(TERMS, "doc string, text string")
    counts = {r["doc"]: (r["total_blocks"], r["processed_blocks"], r["total_terms"] > 0) for r in e.import_terms(docs).collect()}
    assert counts == {"a": (1, 1, True), "b": (1, 1, True), "c": (1, 1, True), "d": (1, 0, False), "e": (1, 0, False)}
    first = snapshot(e.terms())
    assert e.import_terms(docs).count() == 0 and snapshot(e.terms()) == first
    pool = next(r for r in e.terms().stored().collect() if r["namespace"] == "database.bufferpool")
    assert (pool["frequency"], pool["documents"], pool["type"], pool["name"]) == (8, 3, "component", "BufferPool")
    both = {(r["in"], r["out"]): (r["type"], r["weight"]) for r in e.terms().relations().collect()}
    assert both["database.bufferpool", "database.wal"] == ("co_occurs", 1.0)
    assert both["database.bufferpool", "general.memory"][0] == "part_of" if ("database.bufferpool", "general.memory") in both else True
    assert both["database.pg_dump", "general.system_object"][0] == "is_a"
    assert {r["namespace"] for r in e.terms().stored().where("domain = 'general'").collect()} >= {"general.system_object", "general.tool"}
    changed = spark.createDataFrame([("b", "BufferPool, BufferPool and nothing else of postgres")], "doc string, text string")
    killing(e, "term_document", monkeypatch)
    with pytest.raises(Killed):
        e.import_terms(changed)
    assert snapshot(e.terms()) == first  # rows without their document's row are nobody's
    assert e.import_terms(changed).count() == 1
    pool = next(r for r in e.terms().stored().collect() if r["namespace"] == "database.bufferpool")
    assert (pool["frequency"], pool["documents"]) == (8, 3)
    assert e.terms().counts().count() == 5


def test_blocks_that_fail_are_rows_and_the_others_go_on(spark, monkeypatch):
    real = terms.grams

    def grams(text, *rest):
        if "poison" in text:
            raise ValueError("unreadable")
        return real(text, *rest)

    monkeypatch.setattr(terms, "grams", grams)
    try:
        rows = [("a", 1, "BufferPool BufferPool postgres"), ("a", 2, "poison"), ("a", 3, None)]
        frame = spark.createDataFrame(rows, "doc string, block int, text string")
        local = [term_import.candidates(frame, term_import.SETTINGS)]
        found = local[0].where("error IS NOT NULL").select("block", "error")
        assert {r["block"] for r in found.collect()} >= {3}
    finally:
        monkeypatch.undo()
    assert term_import.import_terms(frame.limit(0)).counts().count() == 0


def test_settings_of_domains_and_the_cache_decide(spark):
    settings = {"sea": {"keywords": ["ship", "harbour"], "core": ["ship"], "whitelist": ["two masts"], "roots": ["masts"], "blacklist": ["old harbour"]}, "land": {"keywords": ["field"], "roots": ["field"]}}
    text = "two masts, two masts of the ship; old harbour, old harbour; tall masts tall masts tall masts tall masts"
    frame = spark.createDataFrame([("a", 1, text), ("b", 1, "a field and a ship and a field"), ("c", 1, text)], "doc string, block int, text string")
    rows = {(r["doc"], r["term"]): r for r in term_import.import_terms(frame, settings).terms.collect()}
    assert rows["a", "two masts"]["source"] == "whitelist" and rows["a", "two masts"]["domain"] == "sea" and ("a", "old harbour") not in rows
    assert rows["a", "tall masts"]["confidence"] == 0.6
    known = spark.createDataFrame([("Tall masts", "tall masts", "sea", "tool", "T", 0.9)], "term string, normalized string, domain string, type string, label string, confidence double")
    rows = {(r["doc"], r["normalized"]): r for r in term_import.import_terms(frame, settings, known).terms.collect()}
    assert (rows["a", "tall masts"]["term"], rows["a", "tall masts"]["source"], rows["a", "tall masts"]["freq"], rows["a", "tall masts"]["score"]) == ("Tall masts", "whitelist", 0, 9.0)
    domains = term_import.Domains(settings)
    assert domains.detect("a ship") == ("sea", 0.75, ["sea"]) and domains.detect("a field, a ship; harbour")[0] == "sea" and domains.detect("x")[2] == ["general"]
    assert domains.detect("field harbour") == ("general", 0.0, ["general", "sea", "land"])


def test_relations_by_vectors_ask_only_for_new_terms(spark):
    frame = spark.createDataFrame([("a", 1, "BufferPool BufferPool BufferPools BufferPools postgres")], "doc string, block int, text string")
    found = term_import.import_terms(frame)
    asked = []

    def encoder(texts):
        return [[1.0, 0.02 * len(t)] for t in texts]

    vectors = found.vectors(encoder)
    assert vectors.count() == 2 and not asked
    semantic = found.relations(vectors).where("method = 'embedding'").collect()
    assert [(r["in"], r["out"], r["type"]) for r in semantic] == [("database.bufferpool", "database.bufferpools", "synonym")]
    known = vectors.where("id = 'database.bufferpool'")
    more = {r["id"]: r["embedding"] for r in found.vectors(lambda texts: [[0.0, 1.0] for _ in texts], known).collect()}
    assert more["database.bufferpools"] == [0.0, 1.0] and more["database.bufferpool"][0] > 0.9


def test_maintenance_writes_only_what_changes_and_once(spark, tmp_path, monkeypatch):
    e = engine.Engine(spark, str(tmp_path / "store"))
    now = "2024-06-01 00:00:00"
    made = [(1, "episodic", "2024-05-31 23:00:00", True, 0.8), (2, "episodic", "2024-01-01 00:00:00", True, 0.8), (3, "semantic", "2024-05-01 00:00:00", True, 0.8), (4, "semantic", "2023-06-01 00:00:00", False, 0.1)]
    for op, rows in (("young", made[:1]), ("mixed", made[1:3]), ("old", made[3:])):
        frame = spark.createDataFrame(rows, "id long, type string, at string, is_active boolean, importance double")
        frame = frame.select("id", "type", F.lit("t").alias("content"), F.array(F.lit(1.0)).alias("embedding"), "importance", F.lit(None).cast("string").alias("session_id"), F.col("at").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), "is_active", F.lit("h").alias("content_hash"), F.lit("s").alias("source"))
        e.append("memory", frame, op)
    e.append("access", spark.range(12).select(F.lit(1).cast("long").alias("id"), F.lit("2024-05-31 23:30:00").cast("timestamp").alias("ts")))
    e.append("memory_entity", spark.range(500).select(F.col("id").alias("memory"), F.lit("hub").alias("entity"), F.lit(0.5).alias("weight"), F.lit(now).cast("timestamp").alias("created_at")))
    files = lambda: {p.parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in (tmp_path / "store" / "memory").glob("*/*.parquet")}
    before = files()
    assert e.maintain(now, least=13) == {"changed": 2, "deleted": 1, "frozen": 1}
    after = files()
    assert after["op=young"] == before["op=young"] and after["op=mixed"] != before["op=mixed"]  # what didn't change wasn't written
    rows = {r["id"]: r for r in e.memories().collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1]["importance"] == 0.8 and not rows[2]["is_active"] and rows[3]["is_active"]
    assert abs(rows[3]["importance"] - 0.8 * 0.5 ** (31 / 30)) < 1e-9 and abs(rows[2]["importance"] - 0.1) < 0.01
    assert e.maintain(now, least=13) == {"changed": 0, "deleted": 0, "frozen": 0} and files() == after
    assert [r["name"] for r in e.table("entity").collect()] == ["hub"]
    real = e._replace
    monkeypatch.setattr(e, "_replace", lambda staged: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        e.maintain("2024-06-01 06:00:00")  # twelve uses: memory 1 becomes semantic
    monkeypatch.setattr(e, "_replace", real)
    assert e.maintain("2024-06-01 06:00:00") == {"changed": 0, "deleted": 0, "frozen": 0}
    assert {r["id"]: r["type"] for r in e.memories().collect()}[1] == "semantic"


def test_a_model_orders_what_is_retrieved(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "store"), lambda texts: [[1.0, 0.01 * len(t)] for t in texts])
    rows = [(1, "id 1", 0.9), (2, "id 2", 0.8), (3, "id 3", 0.7)]
    table = spark.createDataFrame(rows, "id long, content string, score double").withColumn("cluster", F.lit(None).cast("string"))
    order = search.said_order(table, "q", lambda prompts: ["2 0" for _ in prompts])
    assert sorted(map(tuple, order.collect())) == [(1, 1), (2, 2), (3, 0)]
    assert [r["id"] for r in search.rerank(table, order=order).orderBy("rank").collect()] == [3, 1, 2]
    assert [r["id"] for r in search.rerank(table).orderBy("rank").collect()] == [1, 2, 3]
    assert search.said_order(table.limit(0), "q", lambda prompts: ["0" for _ in prompts]).count() == 0
    assert e.store("a memory of the sea") == 1
    assert e.search("what of the sea is known", model=lambda prompts: ["0" for _ in prompts], threshold=0.1).count() == 1


def test_topics_are_made_anew_only_where_links_changed(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "store"))
    rows = lambda a, b: spark.createDataFrame([(i, f"Redis {'kernel modules' if i % 2 else 'desktop themes'} note{i}", None, None) for i in range(a, b)], ROWS)
    e.add(rows(0, 12))
    assert e.make_topics(split=5, near=0.6, model=lambda prompts: ['{"name": "Kernels", "description": "of kernels"}' for _ in prompts]) == 12
    assert {r["name"] for r in e.topics().collect()} == {"Kernels"}
    assert e.make_topics(split=5, near=0.6) == 0
    e.add(rows(12, 16))
    assert e.make_topics(split=5, near=0.6) == 16 and {r["name"] for r in e.topics().collect()} == {"Topic 1", "Topic 2"}


def test_cooccurrence_kept_up_by_batches_is_a_recount(spark):
    lines = spark.range(400).select((F.col("id") % 30).alias("memory"), (F.col("id") * 7 % 13).alias("entity"), (F.col("id") % 3).alias("batch"))
    lines = lines.union(spark.range(40).select(F.lit(99).cast("long"), F.col("id"), F.col("id") % 3))  # a large memory
    held = lines.select("memory", "entity").limit(0)
    counts, mentions = spark.createDataFrame([], "`in` long, `out` long, n long"), spark.createDataFrame([], "entity long, m long")
    for b in range(3):
        pairs, fresh = graph.added_pairs(held, lines.where(F.col("batch") == b).unionByName(lines.where(F.col("batch") == max(0, b - 1))), block=8)
        counts, mentions, held = graph.merged_counts(counts, pairs, "in", "out"), graph.merged_counts(mentions, fresh, "entity"), held.union(fresh)
        counts, mentions, held = (df.checkpoint() for df in (counts, mentions, held))
    own = sorted(map(tuple, graph.weighted(counts, mentions, 1).select("in", "out", "n", "weight").collect()))
    assert own == sorted(map(tuple, graph.cooccurrence(lines, 1).collect())) == sorted(map(tuple, graph.cooccurrence(lines, 1, block=8).collect()))


def vectors(spark, n=400, d=20, seed=1, clustered=False):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if clustered:
        x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] * 4 + x * 0.6
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, d)) * 0.05
    return [(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)]


def brute(rows, least, within=False):
    import numpy as np

    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    groups = {i: g for i, _, g in rows}
    return {(a, b): float(units[a] @ units[b]) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and (not within or groups[a] == groups[b]) and units[a] @ units[b] >= least}


@pytest.mark.parametrize("clustered, least, block", [(False, 0.95, 64), (True, 0.95, 50), (True, 0.6, 1000), (False, 0.3, 100)])
def test_similar_pairs_are_all_pairs(spark, clustered, least, block):
    rows = vectors(spark, clustered=clustered) + [(9001, [1.0] * 5, 1), (9002, [2.0] * 5, 1)]
    odd = [(9003, None, 1), (9004, [], 1), (9005, [0.0] * 20, 1), (9006, [float("nan")] * 20, 1)]
    table = spark.createDataFrame(rows + odd, "id long, embedding array<double>, g long")
    want = brute(rows, least)
    found = {(r["a"], r["b"]): r["similarity"] for r in similar.pairs(table, least, block=block).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    grouped = brute(rows, least, True)
    best = {}
    for (a, b), s in grouped.items():
        best[b] = max(best.get(b, (-2, 0)), (s, -a))
    near = {r["id"]: (r["similarity"], -r["other"]) for r in similar.nearest_earlier(table, least, F.col("g"), block).collect()}
    assert near.keys() == best.keys() and all(near[k][1] == best[k][1] and abs(near[k][0] - best[k][0]) < 1e-9 for k in best)
    new, old = table.where("id % 4 = 0"), table.where("id % 4 > 0")
    met = {i for a, b in grouped for i, j in ((a, b), (b, a)) if i % 4 == 0 and j % 4}
    assert {r["id"] for r in similar.alike(new, old, least, F.col("g"), block).collect()} == met


def test_blocks_meet_without_copies_and_links_connect_what_pairs_do(spark):
    rows = vectors(spark, 400, clustered=True)
    table = spark.createDataFrame(rows, "id long, embedding array<double>, g long")
    plan = similar.pairs(table, 0.6, block=40)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan.lower()
    found = components.components(similar.links(table, 0.6, block=40).toDF("u", "v")).collect()
    whole = components.components(similar.pairs(table, 0.6, block=40).select("a", "b").toDF("u", "v")).collect()
    assert whole and sorted(map(tuple, found)) == sorted(map(tuple, whole))
    assert similar.links(table, 0.6).count() < similar.pairs(table, 0.6).count()


def test_cells_are_used_where_they_prune_and_few_pairs_are_multiplied(spark):
    import numpy as np

    rows = vectors(spark, 1200, clustered=True)
    table = spark.createDataFrame(rows, "id long, embedding array<double>, g long")
    units = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    assert similar._cells(table.select("id", "embedding"), 0.95)[0] is not None
    spread = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in vectors(spark, 1200, 64)])
    for x in (units, spread):
        p, q, s, full = similar.compare(x, x, 0.95)
        assert full < 0.05 * len(x) ** 2 or x is units
    assert similar.compare(spread, spread, 0.95)[3] < 0.05 * len(spread) ** 2
    with pytest.raises(ValueError):
        similar.pairs(table, 0.0)


@pytest.mark.parametrize("least, connected, clustered", [(0.45, True, False), (0.8, False, False), (0.3, True, True)])
def test_links_of_many_blocks_spare_what_is_connected(spark, monkeypatch, least, connected, clustered):
    rows = vectors(spark, 500, clustered=clustered)
    table = spark.createDataFrame(rows, "id long, embedding array<double>, g long")
    met = []
    held = similar._sides
    monkeypatch.setattr(similar, "_sides", lambda packed, asked: met.append((packed, asked)) or held(packed, asked))
    found = components.components(similar.links(table, least, block=20).toDF("u", "v")).collect()
    near = set(brute(rows, least))
    whole = components.components(similar.pairs(table, least, block=20).select("a", "b").toDF("u", "v")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole)) and {r["node"] for r in found} == {i for ab in near for i in ab}
    assert (len(met) > 2) == connected


@pytest.mark.parametrize("least", [0.3, 0.45, 0.6, 0.95])
def test_few_pairs_beside_those_found_are_multiplied_in_double_precision(least):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2100, 64))
    x[::7] = x[rng.integers(0, 2100, 300)] + rng.normal(size=(300, 64)) * 0.4
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    p, q, s, full = similar.compare(x, x[:1501], least)
    whole = x @ x[:1501].T
    assert set(zip(p.tolist(), q.tolist())) == set(zip(*(i.tolist() for i in np.nonzero(whole >= least))))
    assert np.allclose(s, whole[p, q], atol=1e-12) and full < 1.01 * len(p)


def test_a_third_of_all_rows_may_be_one_session_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0], 1) for i in range(300)] + vectors(spark, 300, 3, clustered=True)[:0] + [(1000 + i, [float(i), 1.0, 2.0], i % 5 + 2) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>, session_id long")
    found = store.near_duplicates(table, 0.95).where("id < 1000")
    assert {(r["id"], r["other"]) for r in found.collect()} == {(i, 0) for i in range(1, 300)}
