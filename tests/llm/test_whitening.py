"""Whitening against numpy on the gathered rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackenlog.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, label int"


def gathered(rows):
    """The same by plain covariance and eigenvectors."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    d = n * x.astype(object) - x.astype(object).sum(0)
    y = d.astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)
    return n, (d**2).sum(1), e[order], v[:, order], y


def check(df, rows, k):
    n, deviation, e, v, y = gathered(rows)
    found = df.collect()
    assert len(found) == n * k
    by = {(r.vec_id, r.component): r for r in found}
    for c in range(1, k + 1):
        own = np.array([by[i, c].whitened for i, _ in rows])
        want = y @ v[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-8
        assert {r.explained for r in found if r.component == c} == {by[rows[0][0], c].explained}
        assert abs(by[rows[0][0], c].explained - e[c - 1] / e.sum()) < 1e-9
    assert [by[i, 1].deviation for i, _ in rows] == deviation.tolist()
    assert {r.n for r in found} == {n} and {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-8


def spread(count, d, seed, condition=1.0):
    rng = np.random.default_rng(seed)
    scale = np.logspace(0, -condition, d) * 3
    mix = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return [(i, [float(c) for c in row]) for i, row in enumerate((rng.normal(size=(count, d)) * scale) @ mix)]


@pytest.mark.parametrize("count,d,k", [(300, 6, 6), (700, 40, 32), (40, 3, 3)])
def test_components_equal_those_of_the_covariance(spark, count, d, k):
    rows = spread(count, d, seed=d)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS).repartition(5)
    check(whitening.whiten(df), rows, k)


def test_odd_vectors_are_left_out_and_other_columns_ignored(spark):
    rows = spread(60, 4, seed=1)
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows + odd], COLUMNS).withColumns({"component": F.lit("x"), "whitened": F.lit(1), "n": F.lit(None)})
    check(whitening.whiten(df), rows, 4)


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [float(i % 7), float(2 * (i % 7)), 5.0, float((i * i) % 5)]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS)).collect()
    assert {r.component for r in found} == {1, 2} and len(found) == 100 and found[0].identity_error < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_spread_gives_no_rows(spark, rows):
    df = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0


def test_repeated_and_null_keys_and_large_entries(spark):
    rows = [(None, [1e30, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1e30, 2.0])]
    found = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS)).collect()
    assert len(found) == 4 * len({r.component for r in found}) and all(np.isfinite(r.whitened) for r in found)
    assert {r.deviation for r in found} - {None} and None in {r.deviation for r in found}


def test_ill_conditioned_rows_take_more_passes_and_stay_orthonormal(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 3)) * 4000
    rows = [(i, [float(a), float(b), float(a + b + 0.05 * c)]) for i, (a, b, c) in enumerate(base)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    fit = whitening.fit(df, "embedding", 3)
    assert 3 <= fit.passes <= whitening.MOST_PASSES and len(fit.eigenvalues) == 3
    assert whitening.identity_error(df, "embedding", fit, 3) < 1e-6
