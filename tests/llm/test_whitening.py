"""Whitening against plain integer and numpy arithmetic, and its hard rows."""

import math

import numpy as np
import pytest

from ledgerloom.llm.whitening import bit_sliced_products, fit, whiten, whitened_components

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, dim int, whitened double")


def integers(rows):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]


@pytest.mark.parametrize("spread", [1, 70, 2**20, 2**46])
def test_bit_planes_are_exact(spread):
    random = np.random.default_rng(spread)
    x = random.integers(-spread, spread, (131, 5), endpoint=True)
    x[:, 2] = 7
    sums, products = bit_sliced_products(x)
    plain = [[int(v) for v in row] for row in x]
    assert list(sums) == [sum(r[i] for r in plain) for i in range(5)]
    assert products.tolist() == [[sum(r[i] * r[j] for r in plain) for j in range(5)] for i in range(5)]


def test_whitening_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {(r.vec_id, r.component): r for r in whitened_components(table).collect()}
    source = {r.vec_id: r.embedding for r in table.collect()}
    ids = sorted(source)
    x = integers(source[i] for i in ids)
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    covariance = np.array([[(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j]) / n**2 for j in range(d)] for i in range(d)])
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    assert len(got) == n * min(d, 32)
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    for k in range(min(d, 32)):
        want = centred @ directions[:, k] / np.sqrt(values[k])
        mine = np.array([got[i, k + 1].whitened for i in ids])
        sign = np.sign(mine @ want)
        assert np.allclose(mine, sign * want, rtol=1e-7, atol=1e-7)
        assert math.isclose(got[ids[0], k + 1].explained, values[k] / np.trace(covariance), rel_tol=1e-9)
    for i, row in zip(ids, x, strict=True):
        assert got[i, 1].deviation == sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) == int(got[i, 1].deviation_exact)
    assert {r.n for r in got.values()} == {n}
    errors = {r.identity_error for r in got.values()}
    assert len(errors) == 1 and max(errors) <= 1e-9


def test_hard_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [0.0, 2.0, 5.0]), (3, None), (4, [None, 1.0, 1.0]),
            (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [-4.5, 2.0, 1.0]),
            (9, [1e30, 0.0, 0.0]), (10, [5.0]), (11, [6.0]), (12, [7.0, 7.0])]
    got = whitened_components(vectors(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(k for k in by if k) == [1, 8, 10, 11, 12] and len(by[None]) == 3 and len(by[1]) == 6
    assert {r.n for r in by[1]} == {4} and {r.n for r in by[10]} == {2} and {r.n for r in by[12]} == {1}
    # The second entry never varies, so three vectors in a plane leave at least one direction flat.
    assert [r.whitened for r in by[8] if r.component == 3] == [None]
    assert all(r.whitened is None and r.explained is None for r in by[12])
    assert sorted(r.whitened for r in by[10] + by[11]) == [-1.0, 1.0]
    assert all(r.identity_error <= 1e-9 for r in got)


def test_no_vectors(spark):
    assert whitened_components(vectors(spark, [])).collect() == []
    assert whitened_components(vectors(spark, [(1, None)])).collect() == []


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(2**40) if i % 2 else 0.0]) for i in range(64)]
    got = [r for r in whitened_components(vectors(spark, rows)).collect() if r.vec_id == 0][0]
    assert got.deviation is None and int(got.deviation_exact) == (32 * 2**46) ** 2


def test_fit_once_and_project_other_rows(spark):
    fitted = fit(vectors(spark, [(i, [float(i), float(i * i % 7)]) for i in range(50)]))
    assert [len(r.whitened) for r in whiten(vectors(spark, [(1, [3.0, 4.0]), (2, [1.0])]), fitted).collect()] == [2]
