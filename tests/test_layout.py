"""Tables laid out by key: look-ups read a bucket, joins and patches don't shuffle; operators that only pytest runs."""

import re

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import texts
from palimpsest.operators import documents, search, store
from palimpsest.sources import layout

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_by_key_is_read_and_joined_without_a_shuffle(spark, tmp_path):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("memory"), F.col("l_partkey").alias("entity")).agg(F.max("l_quantity").alias("weight"))
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    try:
        layout.save_by_key(lines, "links_by_entity", "entity", "memory", buckets=8, path=str(tmp_path / "links"))
        layout.save_by_key(parts, "parts_by_entity", "entity", buckets=8, path=str(tmp_path / "parts"))
        links, named = layout.by_key(spark, "links_by_entity"), layout.by_key(spark, "parts_by_entity")
        assert len(list((tmp_path / "links").glob("*.parquet"))) == 8
        own = store.lookup(links, "entity", 7)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, lines.select(*own.columns).where("entity = 7").collect()))
        assert own.select(F.input_file_name()).distinct().count() == 1
        joined = links.join(named.hint("merge"), "entity")
        assert "Exchange" not in plan(joined) and joined.count() == lines.join(parts, "entity").count()
        changes = named.where("entity % 5 = 0").select("entity", F.upper("name").alias("name"))
        layout.save_by_key(changes, "changes_by_entity", "entity", buckets=8, path=str(tmp_path / "changes"))
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            patched = store.patch(named, layout.by_key(spark, "changes_by_entity"), "entity")
            assert "Exchange" not in plan(patched)
            assert {r["entity"]: r["name"] for r in patched.collect()} == {r["entity"]: r["name"].upper() if r["entity"] % 5 == 0 else r["name"] for r in parts.collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        held = own.select(F.input_file_name()).first()[0].rsplit("/", 1)[1]
        for other in (tmp_path / "links").glob("*.parquet"):
            if other.name != held:
                other.write_bytes(b"not read")
        memories = spark.range(10).select("id", F.lit("x").alias("content"))
        assert own.count() == lines.where("entity = 7").count() and search.search_by_entity(links, memories, 7).count() == min(10, own.count())
    finally:
        for t in ("links_by_entity", "parts_by_entity", "changes_by_entity"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_repetition_is_that_of_naive_rules(spark):
    said = [r[0] for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("text").collect()]
    said += ["", "a", "ab ab ab", "abcabcabc", "one two one two one", "x y z w", "so so so it is", "na na na na batman", "  a b a b  "]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    found = {r["id"]: (r["r"], r["c"]) for r in rows.select("id", texts.repetitive(F.col("text")).alias("r"), texts.without_repetition(F.col("text")).alias("c")).collect()}
    for k, t in enumerate(said):
        if t is None:
            assert found[k] == (None, None)
            continue
        words = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" "))
        thrice = any(t[i : i + n] == t[i + n : i + 2 * n] == t[i + 2 * n : i + 3 * n] and "\n" not in t[i : i + 3 * n] for n in range(2, len(t) // 3 + 1) for i in range(len(t) - 3 * n + 1))
        assert found[k][0] == (len(t) < 2 or thrice or (len(words) > 3 and len(set(words)) < len(words) * 0.5))
    assert [found[len(said) - 3][1], found[len(said) - 2][1]] == ["so it is", "na batman"]


def naive_clusters(rows, near, most, left):
    """Leaders in order; (id, cluster) with -1 for what is near none."""
    leaders, out = [], {}
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    for i, v in rows:
        near_ones = [k for k, leader in enumerate(leaders) if cosine(v, leader) > near]
        if near_ones:
            out[i] = near_ones[0]
        elif len(leaders) < most:
            out[i] = len(leaders)
            leaders.append(v)
        else:
            best = max(range(len(leaders)), key=lambda k: (cosine(v, leaders[k]), -k))
            out[i] = best if cosine(v, leaders[best]) > left else -1
    return out


def test_leaders_are_those_of_a_naive_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) + 2 * np.eye(4)[i % 3]).tolist(), i % 2) for i in range(120)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>, g int")
    found = documents.leader_clusters(table, "g", 0.8, 4, 0.5, 50).collect()
    want = {}
    for g in (0, 1):
        want |= naive_clusters([(i, np.array(v)) for i, v, own in rows if own == g][:50], 0.8, 4, 0.5)
    assert {r["id"]: r["cluster"] for r in found} == want
