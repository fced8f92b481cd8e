"""Whitening against exact sums and an eigendecomposition of its own; refinement on clustered spectra."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from scintlake.llm import whitening


def rows_of_vectors(seed=5, dim=8, n=300):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)) * np.linspace(0.5, 3, dim) + 40
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1]), (900, None), (901, []), (902, [float("nan")] * dim), (903, [None, *[1.0] * (dim - 1)]),
             (904, [float("inf")] * dim), (905, [1e300] * dim), (906, [1.0, 2.0]), (907, [2.0, 5.0]), (908, [4.0, -1.0]), (909, [3.0])]
    return rows


def exact(vectors):
    """n, S, integers and the covariance of the grid vectors in rational numbers."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    d = [[n * r[j] - s[j] for j in range(dim)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n ** 3) for j in range(dim)] for i in range(dim)]
    return n, s, d, np.array(cov, dtype=float)


def test_equals_exact_arithmetic(spark):
    rows = rows_of_vectors()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, n int, component int, dim int").repartition(5)
    got = whitening.whitened(df, components=6).collect()
    good = {8: [(i, v) for i, v in rows if v and len(v) == 8 and all(c is not None and np.isfinite(c) and c < 1e17 for c in v)],
            2: [(i, v) for i, v in rows if v and len(v) == 2], 1: [(909, [3.0])]}
    ids = {dim: {i for i, _ in g} for dim, g in good.items()}
    assert Counter(r["vec_id"] for r in got) == Counter({i: 0 for i in ()}) + Counter(
        i for dim, g in good.items() for i, _ in g for _ in range(min(dim, 6)))
    for dim, g in good.items():
        n, s, d, cov = exact([v for _, v in g])
        mine = [r for r in got if r["vec_id"] in ids[dim]]
        assert {r["n"] for r in mine} == {n}
        want = Counter((i, sum(c * c for c in r)) for (i, _), r in zip(g, d))
        assert Counter({k: v * min(dim, 6) for k, v in want.items()}) == Counter((r["vec_id"], r["deviation"]) for r in mine)
        if dim == 1:
            assert [(r["whitened"], r["explained"], r["identity_error"]) for r in mine] == [(None, 0.0, 0.0)]
            continue
        e, q = np.linalg.eigh(cov)
        e, q = e[::-1], q[:, ::-1]
        told = {r["component"]: r["explained"] for r in mine}
        assert np.allclose([told[c + 1] for c in range(min(dim, 6))], e[:6] / np.trace(cov), rtol=1e-10)
        assert max(r["identity_error"] for r in mine) < 1e-10
        by_id = {}
        for r in mine:
            by_id.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
        for c in range(min(dim, 6)):
            w = np.array(d, dtype=float) @ q[:, c] / n / np.sqrt(e[c])
            mine_w = np.array([by_id[i, sum(x * x for x in r)][c + 1] for (i, _), r in zip(g, d)])
            assert min(np.abs(mine_w - w).max(), np.abs(mine_w + w).max()) < 1e-9


def test_far_values_stay_exact(spark):
    rows = [(i, [1e12 + i, -3e9 * i, 0.25 * i * i]) for i in range(50)] + [(99, [1e15, 1e15, 1e15])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, s, d, cov = exact([v for _, v in rows])
    squares = {i: sum(c * c for c in r) for (i, _), r in zip(rows, d)}
    assert all(r["deviation"] == (squares[r["vec_id"]] if squares[r["vec_id"]] < 1 << 63 else None) for r in got)
    assert len(got) == 153 and any(r["deviation"] is None for r in got)


def test_constant_and_deficient_tables(spark):
    got = whitening.whitened(spark.createDataFrame([(i, [0.5, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert len(got) == 18 and all((r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (None, 0.0, 0.0, 0) for r in got)
    rnd = np.random.default_rng(1)
    got = whitening.whitened(spark.createDataFrame([(i, rnd.normal(size=12).tolist()) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 4) and r["identity_error"] < 1e-9 for r in got)
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 3, 40), np.r_[1 + 1e-10 * np.arange(15), 1e-6 * (1 + 1e-8 * np.arange(10)), np.linspace(2, 3, 15)], np.full(40, 2.0),
    np.r_[np.zeros(30), np.ones(10)], np.geomspace(1e-12, 1, 40)])
def test_refinement_in_extended_precision(spectrum):
    n = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ ((np.eye(n) - q.T @ q) / 2)
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.refine(a)
    assert np.abs(a @ x - x * e).max() < 1e-17 and np.abs(x.T @ x - np.eye(n)).max() < 1e-17
    assert np.abs(e - np.sort(spectrum)[::-1]).max() < 1e-17
