import math
from fractions import Fraction

import numpy as np
import pytest

from civicspark.llm import whitening as W


@pytest.fixture
def embeddings(spark):
    """(vec_id, embedding) pairs, beside columns whose names clash with those of the result."""

    def made(rows, kind="array<double>"):
        schema = f"vec_id long, embedding {kind}, n string, component string, x string, whitened string, label int"
        return spark.createDataFrame([(i, v, "n", "c", "x", None, None) for i, v in rows], schema)

    return made


def exact(vectors):
    """Distinct whole vectors, their sums and their covariance, exact."""
    found = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, sums = len(found), [sum(c) for c in zip(*found, strict=True)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(v, sums, strict=True)] for v in found]
    covariance = [[sum(r[a] * r[b] for r in centred) / n for b in range(len(sums))] for a in range(len(sums))]
    return n, sums, covariance


def check(embeddings, vectors, most=4, close=1e-9):
    frame = embeddings(list(enumerate(vectors)))
    model = W.fit(frame, most)
    n, sums, covariance = exact(vectors)
    rows = W.whiten(frame, model).collect()
    values, _ = np.linalg.eigh(np.array(covariance, dtype=np.longdouble).astype(float))
    assert model.n == n and model.identity_error < 1e-9
    assert model.trace == pytest.approx(float(sum(covariance[k][k] for k in range(len(sums)))), rel=1e-12)
    held = np.array(covariance, dtype=float)
    for k in range(len(model.variances)):
        v = model.components[:, k]
        assert np.linalg.norm(v) == pytest.approx(1, rel=1e-12)
        assert np.abs(held @ v - model.variances[k] * v).max() <= 1e-12 * values[-1] * len(sums)
        assert model.variances[k] == pytest.approx(values[-1 - k], rel=1e-6)
    for r in rows:
        whole = [math.floor(256 * c) for c in vectors[r.vec_id]]
        assert r.n == n and r.deviation == sum((n * x - s) ** 2 for x, s in zip(whole, sums, strict=True))
        k = r.component - 1
        centred = np.array([float(Fraction(n * x - s, n)) for x, s in zip(whole, sums, strict=True)])
        assert r.whitened == pytest.approx(centred @ model.components[:, k] / math.sqrt(model.variances[k]), abs=close)
        assert r.explained == pytest.approx(model.variances[k] / model.trace, rel=1e-12)
    return model, rows


def test_equals_the_exact_covariance(embeddings):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(60, 7)) @ rng.normal(size=(7, 7)) / 4).tolist()
    model, rows = check(embeddings, vectors + vectors[:5] + [vectors[0]] * 40)
    assert model.n == 60 and len(rows) == 4 * 105


@pytest.mark.parametrize("spread", [1e3, 1e5])
def test_very_unequal_deviations(embeddings, spread):
    """A covariance whose eigenvalues are far apart, turned out of the axes."""
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    vectors = (rng.normal(size=(300, 5)) * spread ** np.array([0, -0.2, -0.5, -0.8, -1]) @ turn * spread + 7e5).tolist()
    frame = embeddings(list(enumerate(vectors)))
    model = W.fit(frame, 4)
    assert len(model.variances) == 4 and model.identity_error < 1e-8
    rows = sorted((r.component, r.vec_id, r.whitened) for r in W.whiten(frame, model).collect())
    held = np.array([r[2] for r in rows]).reshape(4, -1)
    assert np.abs(np.cov(held, bias=True) - np.eye(4)).max() < 1e-8


def test_dependent_and_constant_dimensions(embeddings):
    rng = np.random.default_rng(3)
    plane = rng.integers(-50, 50, size=(40, 2)) / 4
    vectors = np.column_stack([plane, plane @ [1, 2], np.full(40, 3.25)]).tolist()
    model, rows = check(embeddings, vectors)
    assert len(model.variances) == 2 and {r.component for r in rows} == {1, 2}
    assert [len(W.fit(embeddings(list(enumerate(v))), 4).variances) for v in ([[1.0, 2.0]] * 3, [[1.0, 2.0], [2.0, 5.0]])] == [0, 1]


def test_rows_left_out_and_ids(embeddings):
    vectors = [[0.5, 1.0], [2.0, -1.0], [0.25, -0.0], [0.25, 0.0]]
    others = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    frame = embeddings([(k, v) for k, v in enumerate(vectors + others)] + [(None, [0.5, 1.0]), (0, [0.5, 1.0])])
    model = W.fit(frame, 4)
    rows = W.whiten(frame, model).collect()
    assert model.n == 3 and sorted({r.vec_id for r in rows if r.vec_id is not None}) == [0, 1, 2, 3]
    assert sum(r.vec_id is None for r in rows) == 2 and sum(r.vec_id == 0 for r in rows) == 4


def test_entries_beyond_the_integers(embeddings):
    frame = embeddings([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 9.0])])
    rows = W.whiten(frame, W.fit(frame, 4)).collect()
    assert rows and all(math.isfinite(r.whitened) for r in rows)
    assert {r.deviation for r in rows if r.vec_id != 3} == {None}


def test_tables_without_vectors(embeddings):
    for rows in ([], [(1, None), (2, [])]):
        frame = embeddings(rows)
        found = W.whiten(frame, W.fit(frame, 4))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert found.count() == 0


def test_whole_table(spark, tables):
    given = spark.read.parquet(f"{tables}/embeddings.parquet")
    vectors = [r.embedding for r in given.collect()]
    model = W.fit(given, 4)
    distinct = np.array(sorted({tuple(math.floor(256 * c) for c in v) for v in vectors}), dtype=float)
    values, axes = np.linalg.eigh(np.cov(distinct.T, bias=True))
    assert model.n == len(distinct)
    for k in range(4):
        assert model.variances[k] == pytest.approx(values[-1 - k], rel=1e-10)
        assert abs(axes[:, -1 - k] @ model.components[:, k]) == pytest.approx(1, abs=1e-8)
