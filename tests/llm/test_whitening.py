"""op11: against one eigendecomposition of the exact covariance."""

import math

import numpy as np
import pytest

from mnemosia.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, `_white` long, `a.b` string"


def brute(rows):
    """(components as rows, eigenvalues, exact levels by row, sums, n), by integers and one call of eigh."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) + 0 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(v) for _, v in kept})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[j] for v in distinct) for j in range(d)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in distinct], float) / n
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    return vec.T[::-1], e[::-1], kept, sums, n


def made(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(1, 0.2, d) + 0.3).astype(np.float32).tolist()


def check(spark, rows, dims=None, parts=5):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(parts)
    model, distinct = whitening.fit(df, "embedding")
    vec, e, kept, sums, n = brute(rows)
    assert (model.n, model.sums) == (n, sums)
    k = len(model.values)
    np.testing.assert_allclose(model.values, e[:k], rtol=1e-9)
    got = whitening.whiten(df, model, "embedding", dims)
    assert got.columns == ["row", "whitened", "deviation"] and got.select("row.*").columns == ["vec_id", "_white", "a.b"]
    got = sorted((r.row.vec_id, r.deviation, r.whitened) for r in got.collect())
    dims = k if dims is None else dims
    want = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), ((np.array([n * c - s for c, s in zip(x, sums)], float) / n) @ vec[:dims].T / np.sqrt(e[:dims])).tolist()) for i, x in kept)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    a, b = np.array([g[2] for g in got]), np.array([w[2] for w in want])
    np.testing.assert_allclose(np.abs(a), np.abs(b), atol=1e-7)
    assert (np.abs(np.sign(a) @ np.ones(dims)) >= 0).all() and ((np.abs(a - b).max(axis=0) < 1e-7) | (np.abs(a + b).max(axis=0) < 1e-7)).all()
    assert whitening.identity_error(distinct, model, dims) < 1e-8
    return model


def test_all_dimensions_of_dealt_rows(spark):
    vectors = made(300, 12, 1)
    check(spark, [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[0])] * 40)


def test_more_partitions_than_one_merge_takes(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, list(enumerate(made(200, 5, 2))), 3, 13)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_without_a_vector_do_not_count(spark):
    vectors = made(40, 4, 3)
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [0.0, float("inf"), 0.0, 0.0])]
    check(spark, [(i, v) for i, v in enumerate(vectors)] + bad)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, [])]])
def test_nothing_to_scale_by(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    model, _ = whitening.fit(df, "embedding")
    assert len(model.values) == 0
    assert [r.whitened for r in whitening.whiten(df, model, "embedding").collect()] == [[]] * sum(v is not None for _, v in rows)


def test_constant_dimensions_and_short_vectors(spark):
    rows = [(i, [a, 0.5, b]) for i, (a, b) in enumerate(made(60, 2, 4))]
    assert len(check(spark, rows).values) == 2
    padded = [(1, [0.5]), (2, [0.25, 1.0]), (3, [0.125, 0.5, 0.75]), (4, [0.0, 0.0, 0.25])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in padded], SCHEMA)
    full = spark.createDataFrame([(i, v + [0.0] * (3 - len(v)), 0, "x") for i, v in padded], SCHEMA)
    assert whitening.fit(df, "embedding")[0].sums == whitening.fit(full, "embedding")[0].sums


def test_large_levels_are_exact(spark):
    rows = [(i, [float(2**40 + 4096 * 256 * i), float(i * i)]) for i in range(9)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, `_white` long, `a.b` string")
    model, _ = whitening.fit(df, "embedding")
    assert model.sums == [sum(256 * int(v[j]) for _, v in rows) for j in range(2)]
    for r in whitening.whiten(df, model, "embedding").collect():
        want = sum((9 * 256 * int(c) - s) ** 2 for c, s in zip(dict(rows)[r.row.vec_id], model.sums))
        assert r.deviation == (want if want < 2**63 else None)


def test_query(spark):
    got = whitening.op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    raw = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    vec, e, kept, sums, n = brute(raw)
    assert len(got) == 4 * len(kept) and (got["n"] == n).all() and got.identity_error.max() < 1e-9
    np.testing.assert_allclose(sorted(set(got.explained)), sorted(e[:4] / e.sum()), rtol=1e-9)
