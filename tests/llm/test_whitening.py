import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import whitening


def expected(vectors, most=16):
    """All from the definition, sums in whole numbers: {number of the vector: (deviation, whitened)}, n, explained."""
    x = {i: tuple(math.floor(64 * float(c)) + 1000000 for c in v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    offset = lambda v: np.array([float(Fraction(n * v[k] - sums[k], n)) for k in range(d)])
    a = np.array([offset(v) for v in fit])
    values, axes = np.linalg.eigh(a.T @ a / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-12 * values.sum()).sum()))
    return {i: (sum((n * v[j] - sums[j]) ** 2 for j in range(d)), offset(v) @ axes[:, :k] / np.sqrt(values[:k])) for i, v in x.items()}, n, values[:k] / values.sum()


def check(rows, given, most=16):
    want, n, explained = expected(given, most)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    for i, (deviation, whitened) in want.items():
        assert sorted(got[i]) == list(range(1, len(whitened) + 1))
        assert {r.n for r in got[i].values()} == {n} and {r.deviation for r in got[i].values()} == {deviation}
    for c in range(len(explained)):
        ours, theirs = np.array([got[i][c + 1].whitened for i in want]), np.array([want[i][1][c] for i in want])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-6
        assert abs(got[next(iter(want))][c + 1].explained / explained[c] - 1) < 1e-6
    assert all(r.identity_error < 1e-4 for r in rows)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, component string, n string"


@pytest.mark.parametrize("dim, count", [(5, 200), (20, 300), (3, 40)])
def test_equal_brute_force(spark, dim, count):
    rng = np.random.default_rng(dim)
    made = rng.normal(size=(count, dim)).astype(np.float32) * np.linspace(1, 9, dim, dtype=np.float32) @ rng.normal(size=(dim, dim)).astype(np.float32)
    given = [[float(c) for c in v] for v in made]
    given += [given[0], given[0], None, [None] * dim, [float("nan")] + given[1][1:], [float("-inf")] + given[1][1:]]
    rows = spark.createDataFrame([(i, v, 1, "a", None, "c", "n") for i, v in enumerate(given)], SCHEMA).repartition(4)
    check(whitening.whiten(rows).collect(), given)


def test_flat_directions(spark):
    """Constant and repeated dimensions: as many components as there are directions with variance."""
    rng = np.random.default_rng(1)
    made = [[float(a), 7.0, float(a), float(b), float(a + b)] for a, b in rng.integers(-50, 50, (80, 2))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    found = whitening.whiten(rows).collect()
    assert {r.component for r in found} == {1, 2}
    check(found, made)


def test_scales_far_apart(spark):
    """What the Gram matrix alone would lose: variances eight orders of magnitude apart."""
    rng = np.random.default_rng(4)
    made = (rng.normal(size=(400, 6)) * np.array([1e6, 1e5, 1e4, 1e3, 1e2, 1e1])).tolist()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    x = np.floor(64 * np.array(made))
    exact = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x)
    found = sorted({(r.component, r.explained) for r in whitening.whiten(rows).collect()})
    assert np.allclose([e for _, e in found], exact / exact.sum(), rtol=1e-9)


def test_no_vectors_and_one(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect() == []


def test_huge_entries_and_other_lengths(spark):
    given = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (None, [3.0, 4.0]), (4, [1.0, 2.0, 3.0]), (1, [1e30, 1.0])]
    found = whitening.whiten(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    assert sorted({(r.vec_id is None, r.vec_id or 0, r.n) for r in found}) == [(False, 1, 3), (False, 2, 3), (True, 0, 3)]
    assert all(r.deviation is None for r in found if r.vec_id) and len([r for r in found if r.vec_id == 1]) == 2 * len({r.component for r in found})
