"""Blocked Cholesky over tiles against numpy, with tiles far smaller than the systems."""

import numpy as np
import pytest

from mosaica.operators import cholesky, variance
from mosaica.operators.kernels import Tiles
from test_components import lower


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(14)
    n = 37
    x1, x2 = rng.normal(size=(n, 60)), rng.normal(size=(n, 30))
    k1, k2 = x1 @ x1.T / 60, x2 @ x2.T / 30
    c = np.column_stack((np.ones(n), rng.normal(size=n)))
    y = np.linalg.cholesky(0.8 * k1 + 0.4 * k2 + 0.5 * np.eye(n)) @ rng.normal(size=n) + c @ [1.0, 0.5]
    people = spark.createDataFrame([(i * 3, float(y[i]), 1.0, float(c[i, 1])) for i in range(n)], "indiv long, y double, one double, cov double")
    kernels = lower(spark, k1=k1, k2=k2)
    return k1, k2, c, y, people, kernels, Tiles(kernels, ["k1", "k2"], 8)


def test_forms_and_determinants_side_by_side(study):
    """Three systems, one of them not positive definite, in batches of two."""
    k1, k2, c, y, _, _, tiles = study
    q = np.linalg.qr(c)[0]
    p = np.eye(37) - q @ q.T
    systems = [{"k1": 0.5, "k2": 0.2, "e": 0.3}, {"k1": 0.1, "k2": 0.0, "e": -0.4}, {"k1": 0.0, "k2": 0.9, "e": 0.1}]
    got = cholesky.quadratic_forms(tiles, systems, y, q, side=2)
    for (log, form), w in zip(got, systems, strict=True):
        v = p @ (w["k1"] * k1 + w["k2"] * k2 + w["e"] * np.eye(37)) @ p + q @ q.T
        if np.linalg.eigvalsh(v)[0] <= 0:
            assert log == -np.inf and np.isnan(form)
            continue
        assert log == pytest.approx(np.linalg.slogdet(v)[1], abs=1e-9)
        assert form == pytest.approx((p @ y) @ np.linalg.solve(v, p @ y), rel=1e-10)


def test_inverse_and_traces(study):
    k1, k2, *_, tiles = study
    v = 0.5 * k1 + 0.2 * k2 + 0.3 * np.eye(37)
    log, inv = cholesky.inverse(tiles, {"k1": 0.5, "k2": 0.2, "e": 0.3})
    want = np.linalg.inv(v)
    assert log == pytest.approx(np.linalg.slogdet(v)[1], abs=1e-9)
    np.testing.assert_allclose(inv.whole("v"), want, atol=1e-10)
    got = cholesky.traces(inv, tiles)
    np.testing.assert_allclose([got["k1"], got["k2"], got["e"]], [np.trace(want @ k1), np.trace(want @ k2), np.trace(want)], rtol=1e-10)
    assert cholesky.inverse(tiles, {"k1": 0.5, "k2": 0.2, "e": -5.0}) is None


def test_curve_is_exact_beyond_one_task(study):
    k1, k2, c, y, people, kernels, _ = study
    grid = [0.0, 0.4, 1.0]
    got = variance.correlation_curve(kernels, people, ["one", "cov"], grid, tile=16, direct=0).orderBy("rg").collect()
    for r, g in zip(got, grid, strict=True):
        ll, vg, ve = variance.reml(k1 + g * k2, y, c)
        assert r["loglkl"] == pytest.approx(ll, abs=1e-8)
        np.testing.assert_allclose([r["vg"], r["ve"]], [vg, ve], rtol=1e-4)


def test_components_are_exact_beyond_one_task(study):
    *_, people, kernels, _ = study
    small = variance.reml_components(kernels, ["k1", "k2"], people, ["one", "cov"])
    tiled = variance.reml_components(kernels, ["k1", "k2"], people, ["one", "cov"], tile=16, direct=0)
    assert tiled["rounds"] == small["rounds"]
    np.testing.assert_allclose(list(tiled["var"].values()), list(small["var"].values()), rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(tiled["varcov"], small["varcov"], rtol=1e-6)


def test_peaks():
    f = [lambda t: -((t - 0.3137) ** 2) + 0.1 * (t - 0.3) ** 3, lambda t: -((t - 0.1) ** 2) if t > 0.05 else -np.inf, lambda t: t, lambda t: 4 * t - np.exp(3 * t)]
    got = cholesky.peaks(lambda asked: [f[g](t) for g, t in asked], 4, -0.5, 0.999)
    np.testing.assert_allclose(got, [0.31372827, 0.1, 0.999, np.log(4 / 3) / 3], atol=2e-6)
