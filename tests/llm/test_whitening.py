"""Whitening against numpy's eigenvectors of the covariance, and on odd input."""

import math
import random

import numpy as np
import pytest

from quillspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def check(rows, found, most=4):
    """All results of the rows (id, vector) against numpy."""
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (x - sums / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(by_id) == len({i for i, _ in rows}) and len(found) == len(rows) * min(most, x.shape[1])
    signs = [0] * (most + 1)
    for (i, _), own, projected in zip(rows, x, z, strict=True):
        for k, r in by_id[i].items():
            assert r["n"] == n and r["deviation"] == ((n * own - sums) ** 2).sum() and r["identity_error"] < 1e-9
            assert abs(r["explained"] - values[k - 1] / values.sum()) < 1e-9 * max(r["explained"], 1e-6)
            signs[k] = signs[k] or (1 if r["whitened"] * projected[k - 1] > 0 else -1)
            assert abs(r["whitened"] - signs[k] * projected[k - 1]) < 1e-7


@pytest.mark.parametrize(("rows", "d"), [(300, 64), (40, 3), (30, 1), (9, 5)])
def test_whitening_by_numpy(spark, rows, d):
    rng = np.random.default_rng(rows)
    made = (rng.normal(size=(rows, d)) * np.linspace(5, 1, d) + 3).tolist()
    made = list(enumerate(made + made[:3] * 5))
    check(made, whitening.whitened(spark.createDataFrame(made, SCHEMA).repartition(5)).collect())


def test_query_by_numpy(spark):
    where = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    check(rows, whitening.op11_embedding_whitening(spark, where).collect())


def test_jacobi():
    rng = np.random.default_rng(3)
    for scale in (np.ones(20), np.logspace(0, -12, 20), np.r_[np.ones(17), 0, 0, 0]):
        a = rng.normal(size=(200, 20)) * scale
        values, vectors = whitening.jacobi(whitening.triangle(a))
        assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-13
        by_numpy = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(values, by_numpy, rtol=1e-3, atol=1e-13)  # also the last of widely spread ones, whose squares rounding would swallow
        assert np.allclose((a @ vectors).T @ (a @ vectors), np.diag(values**2), atol=1e-10)


def test_triangles_of_blocks_are_that_of_all():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(70, 6))
    total = np.zeros((6, 6))
    for i in range(0, 70, 9):
        total = whitening.triangle(np.vstack([total, a[i : i + 9]]))
    assert np.allclose(total.T @ total, a.T @ a) and whitening.triangle(a[:2]).shape == (6, 6)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    away = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0, 2.0, 3.0])]
    there = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [3.0, 5.0]), (9, [-0.0, -0.001]), (None, [4.0, 1.0])]
    found = whitening.whitened(spark.createDataFrame([(*r, "x", 1) for r in away + there], SCHEMA + ", component string, n int")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == sorted([(i or 0, k) for i, _ in there for k in (1, 2)])
    assert {r["n"] for r in found} == {4}
    x = np.array([[256, 512], [768, 1280], [0, -1], [1024, 256]])
    assert {r["vec_id"]: r["deviation"] for r in found} == dict(zip((7, 8, 9, None), ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist(), strict=True))
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0 and whitening.whitened(spark.createDataFrame(away[:5], SCHEMA)).count() == 0


def test_nothing_varies(spark):
    flat = whitening.whitened(spark.createDataFrame([(i, [0.5, 1.0]) for i in range(3)], SCHEMA)).collect()
    assert len(flat) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in flat)
    line = whitening.whitened(spark.createDataFrame([(i, [0.5 * i, 1.0]) for i in range(3)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in line)


def test_very_large_entries(spark):
    found = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 2.0])], SCHEMA)).collect()
    assert len(found) == 6 and all(r["deviation"] is None for r in found if r["vec_id"] < 3)


def test_copies_weigh_once(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    once = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    again = whitening.whitened(spark.createDataFrame(rows + [(100 + i, rows[0][1]) for i in range(500)], SCHEMA)).collect()
    for r in again:
        if r["vec_id"] < 50:
            assert abs(abs(r["whitened"]) - abs(once[r["vec_id"], r["component"]])) < 1e-9
