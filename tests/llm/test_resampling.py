"""Importance resampling against a brute-force version and its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import resampling

SCHEMA = "doc_id long, text string, score string, weight int, n string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def texts(seed=1, n=200, most=90):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(("w", "W", "é", "5", "x-y ")) + str(rng.randrange(60)) for _ in range(rng.randrange(most)))) for i in range(n)]


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = WORD.findall(low)
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(rows, target, buckets=10_000, longest=1, least_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x, longest)[1]))
    for x in target:
        t.update(map(bucket, features(x, longest)[1]))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * float(S + buckets)) / ((s[b] + 1) * float(T + buckets))))
    out = []
    for i, x in rows:
        ws, fs = features(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    enough = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 37), (3, 100)])
def test_resampling_is_brute_force(spark, longest, percent):
    rows = texts() + [(900, None), (901, ""), (902, " \t."), (None, "w1 " * 30), (903, "A" * 50_000), (904, "w1 w2 " * 40_000)]
    rows += [rows[7]] * 5 + [(2, rows[9][1])]  # repeated rows, and an id with two texts
    target = [t for _, t in texts(2, 30)] + [None, ""]
    got = resampling.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest, buckets=500)
    assert found(got) == brute(rows, target, 500, longest, percent=percent)


def test_long_texts_are_read_by_pieces(monkeypatch):
    text = "  a bb ccc d 5 é-x  " * 30
    whole = [Counter(f) for _, f in [(0, [x for _, fs in resampling.features_of(text.encode(), 3) for x in fs])]][0]
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 7)
    pieces = list(resampling.features_of(text.encode(), 3))
    assert len(pieces) > 20 and Counter(x for _, fs in pieces for x in fs) == whole
    assert sum(n for n, _ in pieces) == len(WORD.findall(text))
    assert Counter(x.decode() for x in whole.elements()) == Counter(features(text, 3)[1])


def test_a_third_of_all_rows_may_be_one_row(spark, monkeypatch):
    monkeypatch.setattr(resampling, "REPEATS", 7)
    rows = texts(3, 60) + [(77, "w1 w2 w3 w4 " * 6)] * 40
    target = ["w1 w2 w3 w4"] * 9
    got = resampling.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert found(got) == brute(rows, target, percent=30)


def test_empty_tables_and_small_draws(spark):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), target).count() == 0
    rows = texts(4, 9)
    assert found(resampling.resample(frame(spark, rows), target, percent=1)) == brute(rows, [], percent=1)
    assert all(r[4] is None for r in brute(rows, [], percent=1))


def test_the_kth_key_is_that_of_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice((-(2**63), 2**63 - 1, 0, -5, 12, 13, 2**40)), rng.choice((rng.randrange(-9, 9), 2**62)), rng.randrange(1, 4)) for _ in range(300)]
    table = spark.createDataFrame(rows, "a long, b long, copies long")
    keys = sorted((a, b) for a, b, n in rows for _ in range(n))
    for k in (1, 2, 77, 300, len(keys)):
        got, key, below = resampling.kth_key(table, [F.col("a"), F.col("b")], F.col("copies"), lambda n, k=k: k)
        assert (got, tuple(key)) == (k, keys[k - 1]) and below == sum(x < keys[k - 1] for x in keys)


def test_the_query_is_its_sql(spark, tmp_path):
    rows = texts(6) + [(900, None), (901, "É ÀB 5x" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for _, t in texts(7, 20)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.sql(resampling.ORACLE_SQL["op13_resampling"])
    assert want.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(want.fetchall(), key=str) == found(resampling.query(spark, str(tmp_path)))
