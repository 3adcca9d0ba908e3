"""Whitening against a dense eigensolver, with nulls, repeats, ragged and degenerate vectors."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import whitening
from plumbline.llm.storage import Scratch

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(vectors):
    """The fit list's size, sums, eigenvalues (falling) and eigenvectors."""
    x = np.array(sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors}), dtype=object)
    n, total = len(x), x.sum(axis=0)
    far = np.array([[float(n * a - s) / n for a, s in zip(row, total)] for row in x])
    values, basis = np.linalg.eigh(far.T @ far / n)
    return n, total, values[::-1], basis[:, ::-1]


def check(got, rows, dims):
    usable = {k: v for k, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)}
    n, total, values, basis = plain(usable.values())
    most = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == most * sum(k in usable and v is usable[k] or v == usable.get(k) for k, v in rows)
    sign = {}
    for r in got:
        x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in usable[r.vec_id]]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total))
        k = r.component - 1
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        alone = min([abs(values[k] - v) for i, v in enumerate(values) if i != k], default=1) > 1e-6 * values[0]
        if alone:
            want = float(np.array([float(n * a - s) / n for a, s in zip(x, total)]) @ basis[:, k]) / math.sqrt(values[k])
            if abs(want) > 1e-3:
                sign.setdefault(k, math.copysign(1, want * r.whitened))
            assert r.whitened == pytest.approx(sign.get(k, 1) * want, abs=1e-7)


@pytest.mark.parametrize("dims", [1, 3, 20, 40])
def test_equals_a_dense_solver(spark, dims):
    r = np.random.default_rng(dims)
    x = (r.normal(size=(150, dims)) @ np.diag(r.random(dims) + 0.05)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(300, x[3]), (301, x[3])]
    odd = [(400, None), (401, [None] * dims), (402, [float("nan")] * dims), (403, [float("inf")] * dims), (404, []), (405, [1.0] * (dims + 1))]
    df = spark.createDataFrame([(*t, 1) for t in rows + odd], SCHEMA).withColumn("n", F.lit("clash")).repartition(3)
    check(whitening.whiten(df, Scratch(spark)).collect(), rows, dims)


def test_equal_eigenvalues_and_low_rank(spark):
    rows = []
    for i in range(30):  # three pairs of equal eigenvalues, a constant dimension and a copied one
        for s in (1.0, -1.0):
            v = [0.0] * 32
            v[i] = s * (1 + i // 8)
            v[30], v[31] = 0.5, v[0]
            rows.append((len(rows), v))
    df = spark.createDataFrame([(*t, 1) for t in rows], SCHEMA)
    got = whitening.whiten(df, Scratch(spark)).collect()
    check(got, rows, 32)
    assert len({r.component for r in got}) == 16


def test_large_numbers_and_nothing(spark):
    rows = [(i, [float(i * 10**9), float(i % 7)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame([(*t, 1) for t in rows], SCHEMA.replace("float", "double")), Scratch(spark)).collect()
    # The second dimension is zero beside the first one's rounding.
    assert len(got) == 9 and all(r.deviation is None for r in got if r.vec_id != 4) and all(r.deviation for r in got if r.vec_id == 4)
    lone = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)
    assert whitening.whiten(lone, Scratch(spark)).count() == 0
    assert whitening.whiten(lone.limit(0), Scratch(spark)).count() == 0


def test_inertia_and_intervals():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 60):
        a = r.normal(size=(n, n + 3))
        v = a @ a.T
        values = np.linalg.eigvalsh(v)
        inertia = whitening.Inertia(v)
        for s in r.uniform(-1, values[-1] * 1.1, 30):
            assert inertia.above(s) == (values > s).sum()
        top = float(np.abs(v).sum(axis=1).max())
        found = whitening.intervals(inertia, top, 16)
        assert sum(c for _, _, c in found) >= min(16, n)
        for low, high, count in found:
            own, vectors = whitening.feast(v, low, high, count)
            assert np.allclose(np.sort(own), values[(values > low) & (values <= high)], rtol=1e-12)
            assert np.allclose(vectors.T @ vectors, np.eye(count), atol=1e-12)
