import math
import random

import numpy as np
import pytest

from turnwise.llm.whitening import (count_below, exact_products, leading_components, leading_eigenvalues, tridiagonal,
                                    whitened_embeddings)

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int, n string"


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    return (q * values) @ q.T


def test_tridiagonal_form_and_sturm_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 40):
        a = symmetric(rng, rng.normal(size=n))
        d, off, q = tridiagonal(a)
        t = np.diag(d) + np.diag(off, 1) + np.diag(off, -1)
        assert np.allclose(q @ t @ q.T, a, atol=1e-13) and np.allclose(q.T @ q, np.eye(n), atol=1e-13)
        true = np.linalg.eigvalsh(a)
        for x in (-5.0, *true + 1e-6, 5.0):
            assert count_below(d, off, x) == (true < x).sum()
        k = min(4, n)
        assert np.allclose(leading_eigenvalues(d, off, k), true[::-1][:k], atol=1e-13)


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 1, .5], [5, 5, 5, 1, 1, 1], [4, 4 - 1e-9, 4 - 2e-9, 3, 2, 1], [1, 0, 0, 0, 0], [2, 2], [3],
    [1e6, 1e6 - 1, 1, 1e-3, 1e-6], list(np.linspace(1, 2, 64))])
def test_components_are_orthonormal_eigenvectors(values):
    a = symmetric(np.random.default_rng(4), np.array(values, float))
    e, v = leading_components(a, 4)
    true = np.sort(values)[::-1][:4]
    assert np.allclose(e, true[:len(e)], rtol=1e-12, atol=1e-12 * max(true)) and len(e) == (true > 1e-12).sum()
    assert np.allclose(v.T @ v, np.eye(len(e)), atol=1e-12)
    assert np.abs(a @ v - v * e).max() < 1e-12 * max(values)


def test_diagonal_and_zero_matrices():
    e, v = leading_components(np.diag([1.0, 3.0, 2.0]), 2)
    assert np.allclose(e, [3, 2]) and np.allclose(np.abs(v), [[0, 0], [1, 0], [0, 1]])
    assert len(leading_components(np.zeros((3, 3)), 4)[0]) == 0 and len(leading_components(np.zeros((0, 0)), 4)[0]) == 0


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (3, 10 ** 6, 10 ** 9):
        x = rng.integers(-top, top, (50, 3))
        assert (exact_products(x) == x.astype(object).T @ x.astype(object)).all()


def plain(rows, k=4):
    """Whitened rows by numpy's own eigensolver."""
    kept = [(i, [math.floor(float(np.float32(c)) * 256) for c in v]) for i, v, *_ in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [(i, n, int(((n * np.array(x) - sums) ** 2).sum()), ((np.array(x) - sums / n) @ v) / np.sqrt(e)) for i, x in kept], \
        e / np.trace(centred.T @ centred / n)


def test_rows_match_a_plain_solution(spark):
    rng = random.Random(6)
    spread = [3.0, 2.0, 1.2, 0.8, 0.5, 0.4]
    rows = [(i, [rng.gauss(0.3, s) for s in spread], 1, "a", 2, "b") for i in range(300)]
    rows += [(i + 1000, rows[5][1], 1, "a", 2, "b") for i in range(200)]  # copies count once
    rows += [(2000, None, 1, None, None, None), (2001, [], 1, None, None, None),
             (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, None, None, None),
             (2003, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0], 1, None, None, None),
             (2004, [1.0, float("-inf"), 1.0, 1.0, 1.0, 1.0], 1, None, None, None), rows[0]]
    extra = [(2005, [1.0, 2.0], 1, None, None, None)]  # of another length
    vectors = spark.createDataFrame(rows + extra, SCHEMA).repartition(5)
    got = whitened_embeddings(vectors).collect()
    want, share = plain(rows)
    assert len(got) == 4 * len(want) == 4 * 501
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    for vec_id, n, deviation, w in want:
        for c in range(1, 5):
            r = by_row[vec_id][c]
            sign = signs.setdefault(c, np.sign(r["whitened"] * w[c - 1]))
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["whitened"] == pytest.approx(sign * w[c - 1], abs=1e-9)
            assert r["explained"] == pytest.approx(share[c - 1], rel=1e-10) and r["identity_error"] < 1e-9
    assert got[0]["n"] == 300
    again = whitened_embeddings(vectors.repartition(2)).collect()
    assert np.allclose(sorted(map(tuple, again)), sorted(map(tuple, got)), rtol=1e-12, atol=1e-12)


def test_vectors_without_variance(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, "", 0, "") for i in range(9)], SCHEMA)
    assert whitened_embeddings(same).count() == 0 and whitened_embeddings(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [i / 4, i / 2], 1, "", 0, "") for i in range(9)], SCHEMA)
    got = whitened_embeddings(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
