"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np

from palimpsest.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, n string"


def vectors(seed=3, n=300, d=9):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(c)) for c in v] for v in rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + np.linspace(-5, 5, d)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a") for i, v in rows], SCHEMA)


def integers(v):
    return [math.floor(256 * c) for c in v]


def brute(rows, components=4):
    """{(id, component): (n, deviation, |whitened|, explained)} by exact sums and numpy's eigenvectors."""
    fit = sorted({tuple(integers(v)) for _, v in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    means = np.array([s / n for s in sums])
    centred = np.array(fit, float) - means
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    total = sum((n * x - s) ** 2 for v in fit for x, s in zip(v, sums)) / n**3
    out = {}
    for i, v in rows:
        x = integers(v)
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(components, sum(values > 1e-9 * values[0]))):
            out[i, k + 1] = n, deviation, abs((np.array(x) - means) @ axes[:, k]) / math.sqrt(values[k]), values[k] / total
    return out


def agrees(found, want):
    held = {(r["vec_id"], r["component"]): r for r in found}
    assert held.keys() == want.keys()
    for key, (n, deviation, whitened, explained) in want.items():
        r = held[key]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert math.isclose(abs(r["whitened"]), whitened, rel_tol=1e-8, abs_tol=1e-8) and math.isclose(r["explained"], explained, rel_tol=1e-9)
        assert r["identity_error"] < 1e-9


def test_components_are_those_of_numpy_and_deviations_are_exact(spark):
    rows = list(enumerate(vectors()))
    rows += [(1000, rows[5][1]), (1000, rows[5][1])]  # equal vectors count once
    odd = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 7), (2003, [float("nan")] * 9), (2004, [float("inf")] + [0.0] * 8), (2005, [1.0, 2.0])]
    found = whitening.whiten(frame(spark, rows + odd))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert sum(r["vec_id"] == 1000 for r in found) == 8
    agrees([r for r in found if r["vec_id"] != 1000] + [r for r in found if r["vec_id"] == 1000][:4], brute(rows))


def test_whitened_covariance_is_the_identity(spark):
    rows = list(enumerate(vectors(4)))
    found = whitening.whiten(frame(spark, rows)).collect()
    w = np.zeros((len(rows), 4))
    for r in found:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9
    assert len({r["identity_error"] for r in found}) == 1
    for k in range(4):  # the same sign in all rows, and the same in every run
        assert len({(r["vec_id"], r["whitened"] > 0) for r in found if r["component"] == k + 1}) == len(rows)


def test_fewer_directions_give_fewer_components(spark):
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)]
    found = whitening.whiten(frame(spark, line)).collect()
    agrees(found, brute(line))
    assert {r["component"] for r in found} == {1}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        none = whitening.whiten(frame(spark, rows))
        assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**22 + i * i), float(-(2**22) + 7 * i), float(i % 3)]) for i in range(50)]
    found = whitening.whiten(frame(spark, rows)).collect()
    want = brute(rows)
    assert {(r["vec_id"], int(r["deviation"])) for r in found} == {(i, w[1]) for (i, _), w in want.items()}
    x = np.array([[10**9, -(10**9)]], np.int64)  # beyond 64 bits
    assert [int(v) for v in whitening.deviations(x, 10**9, [5, 7]).to_pylist()] == [(10**18 - 5) ** 2 + (-(10**18) - 7) ** 2]


def test_the_query_reads_the_table_and_ids_may_be_null(spark, tmp_path):
    rows = [*enumerate(vectors(6, 60)), (None, vectors(6, 60)[2])]
    frame(spark, rows).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = whitening.query(spark, str(tmp_path))
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    found = found.collect()
    assert sum(r["vec_id"] is None for r in found) == 4
    agrees([r for r in found if r["vec_id"] is not None], brute(rows[:-1]))
