"""Whitening against dense eigenvectors."""

import numpy as np
import pytest

from palimpsest.llm import op12_whitening as op

SF = "/root/testdata/sf0.001"


def dense(vectors, k=16):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1000000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    z = (n * fit - total) / n
    values, vec = np.linalg.eigh(z.T @ z / n)
    values, vec = values[::-1][:k], vec[:, ::-1][:, :k]
    return n, total, values, vec, float((z * z).sum() / n), x


def compare(got, ids, vectors, k=16):
    n, total, values, vec, trace, x = dense(vectors, k)
    k = len(values)
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(rows) == sorted(ids)
    w = np.array([[rows[i][c].whitened for c in range(1, k + 1)] for i in ids])
    want = ((n * x - total) / n) @ vec / np.sqrt(values)
    want *= np.sign((w * want).sum(axis=0))
    assert np.abs(w - want).max() < 1e-8
    for i, dev in zip(ids, ((n * x.astype(object) - total) ** 2).sum(axis=1), strict=True):
        assert all(r.n == n and r.deviation == dev and r.identity_error <= 1e-10 for r in rows[i].values())
        assert all(abs(r.explained * trace / values[c - 1] - 1) < 1e-10 for c, r in rows[i].items())


def test_whole_table(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(op.op12_whitening(spark, SF).collect(), [r.vec_id for r in given], [list(r.embedding) for r in given])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(60, 3))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(good)] + [(100, good[0].tolist(), 1), (100, good[0].tolist(), 1)]
    odd = [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [1.0, float("nan"), 2.0], 1), (203, [float("inf"), 0.0, 0.0], 1), (204, [], 1), (205, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component int")
    got = op.whiten(df).collect()
    assert len(got) == 62 * 3 and {r.vec_id for r in got} == {*range(60), 100}
    compare([r for r in got if r.vec_id < 100], list(range(60)), good)
    assert op.whiten(df.limit(0)).count() == 0 and op.whiten(df.where("vec_id >= 200 AND vec_id < 205")).count() == 0
    one = op.whiten(df.where("vec_id = 7")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 3


@pytest.mark.parametrize("kind", ["flat", "deficient", "steep", "pairs"])
def test_close_and_missing_variances(spark, kind):
    """Whatever basis equal variances take, whitened vectors have the identity as covariance."""
    rng = np.random.default_rng(3)
    if kind == "flat":
        v = np.concatenate([np.eye(20), -np.eye(20)]) * 3
    elif kind == "deficient":
        v = rng.integers(-9, 9, (200, 4)) @ rng.integers(-3, 3, (4, 20)) / 64.0
    elif kind == "steep":
        v = rng.normal(size=(300, 20)) * 10.0 ** -np.linspace(-3, 1, 20)
    else:
        q = rng.integers(-99, 99, (80, 10))
        v = np.concatenate([np.hstack([q, p]) for p in (0 * q,)] + [np.hstack([0 * q, q]), np.hstack([-q, 0 * q]), np.hstack([0 * q, -q])]) / 8.0
    got = op.whiten(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    n, _, values, *_ = dense(v)
    there = values > 1e-9 * values[0]
    assert {r.identity_error for r in got if True}.pop() < 1e-9
    for c, value in enumerate(values, 1):
        mine = [r for r in got if r.component == c]
        assert len(mine) == len(v)
        if there[c - 1]:
            assert abs(mine[0].explained * dense(v)[4] / value - 1) < 1e-6
        else:
            assert {r.whitened for r in mine} == {0.0}


def test_dqds_and_twisted_vectors():
    rng = np.random.default_rng(4)
    for dim in (1, 2, 3, 10, 64):
        for scale in (1.0, 1e-3):
            a, b = rng.normal(size=dim), rng.normal(size=dim - 1) * scale
            m = np.diag(a) + np.diag(b, 1)
            want = np.linalg.svd(m, compute_uv=False)
            assert np.allclose(np.sqrt(op.dqds(a, b)), want, rtol=1e-10, atol=1e-300 + 1e-14 * want[0])
            values, z = op.singular_vectors(a, b, 8)
            assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-10
            assert np.abs(m.T @ (m @ z) - z * values).max() < 1e-12 * want[0] ** 2
    r = np.triu(rng.normal(size=(12, 12)))
    a, b, right = op.bidiagonal(r)
    assert np.allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False))
    assert np.allclose(right.T @ right, np.eye(12))


def test_tree_of_many_parts(spark):
    rows = spark.range(0, 3000, numPartitions=1200).selectExpr("id AS vec_id", "array(cast(id % 7 AS double), cast(id % 11 AS double), rand(1)) AS embedding")
    kept = [(r.vec_id, list(r.embedding)) for r in rows.collect()]
    given = spark.createDataFrame(kept, "vec_id long, embedding array<double>").repartition(1100)
    packed = op.whole_vectors(given, "vec_id", "embedding").select("x")
    n, total = op.sums(packed, 3)
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1000000
    assert n == 3000 and total == x.sum(axis=0).tolist()
    r = op.triangle(packed, n, total)
    z = (n * x - np.array(total)) / n
    assert np.allclose(r.T @ r, z.T @ z)
