"""Pruning, clumping, principal components and variance components against numpy, with tiny tiles and without the direct way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.operators import kernels as K
from mosaica.operators import linkage, simulate, variance


def lower(spark, **mats):
    names = list(mats)
    n = len(mats[names[0]])
    return spark.createDataFrame([(i * 3, j * 3, *(float(mats[k][i, j]) for k in names)) for i in range(n) for j in range(i + 1)], "i long, j long, " + ", ".join(f"{k} double" for k in names)).repartition(3)


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(4)
    n = 40
    x1, x2 = rng.normal(size=(n, 60)), rng.normal(size=(n, 30))
    k1, k2 = x1 @ x1.T / 60, x2 @ x2.T / 30
    c = np.column_stack((np.ones(n), rng.normal(size=n)))
    y = np.linalg.cholesky(0.8 * k1 + 0.4 * k2 + 0.5 * np.eye(n)) @ rng.normal(size=n) + c @ [1.0, 0.5]
    people = spark.createDataFrame([(i * 3, float(y[i]), 1.0, float(c[i, 1])) for i in range(n)], "indiv long, y double, one double, cov double")
    return k1, k2, c, y, people, lower(spark, k1=k1, k2=k2)


@pytest.mark.parametrize("within", [1, 4, 20])
def test_products_within_a_window(spark, within):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 70))
    df = spark.createDataFrame([(b, f, e, float(x[f, e])) for b in (0, 1) for f in range(30) for e in range(70)], "block long, feature long, entity long, x double")
    got = {(r["block"], r["i"], r["j"]): r["x_x"] for r in K.cross_products(df, ["x"], within=within, tasks=9).collect()}
    want = {(b, i, j): x[:, i] @ x[:, j] for b in (0, 1) for i in range(70) for j in range(70) if 0 <= i - j < within}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("frequency", [None, "freq"])
def test_prune(spark, frequency):
    rng = np.random.default_rng(2)
    f = rng.uniform(0.01, 0.99, 80).round(2)
    links = [(s // 40, s, t, float(rng.random())) for s in range(80) for t in range(s) if s // 40 == t // 40 and s - t < 12 and rng.random() < 0.2]
    r2 = spark.createDataFrame(links, "chrom int, s long, t long, r2 double")
    snps = spark.createDataFrame([(i, i // 40, float(f[i])) for i in range(80)], "snp long, chrom int, freq double")
    kept = []
    near = {(s, t) for _, s, t, r in links if r > 0.3 and s - t < 10}
    for v in sorted(range(80), key=lambda v: (-min(f[v], 1 - f[v]) if frequency else 0, v)):
        if not any((max(v, w), min(v, w)) in near for w in kept):
            kept.append(v)
    assert sorted(r["snp"] for r in linkage.prune(r2, snps, 10, 0.3, frequency).collect()) == sorted(kept)


def test_clump(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1, 60) ** 3
    stats = spark.createDataFrame([(i // 30, i, i * 1000, float(p[i])) for i in range(60)], "chrom int, snp long, pos long, p double")
    links = [(i // 30, i, j, float(rng.random())) for i in range(60) for j in range(i) if i // 30 == j // 30 and rng.random() < 0.3]
    cand = linkage.clump_candidates(stats, spark.createDataFrame(links, "chrom int, s long, t long, r2 double"), 0.05, 0.4, 0.5, 8)
    got = {r["index"]: r["members"] for r in linkage.clump(stats, cand, 0.05).collect()}
    linked = {frozenset(x[1:3]) for x in links if x[3] > 0.5 and abs(x[1] - x[2]) <= 8}
    used, want = set(), {}
    for i in sorted((i for i in range(60) if p[i] <= 0.05), key=lambda i: (p[i], i)):
        if i not in used:
            want[i] = [j for j in range(60) if j != i and j not in used and p[j] <= 0.4 and frozenset((i, j)) in linked]
            used |= {i, *want[i]}
    assert got == want and sum(map(len, want.values())) > 5


@pytest.mark.parametrize("direct", [2048, 0])
def test_principal_components(spark, direct):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 8)) * np.array([6, 5, 4, 3, 1, 1, 1, 1])
    k = x @ x.T / 8 + 0.1 * np.eye(50)
    got = K.principal_components(lower(spark, value=k), 4, tile=16, direct=direct).orderBy("entity").toPandas()
    value, vector = np.linalg.eigh(k)
    assert got.entity.tolist() == [3 * i for i in range(50)]
    for c in range(4):
        v = vector[:, -1 - c]
        np.testing.assert_allclose(got[f"pc{c + 1}"], v * np.sign(v[np.abs(v).argmax()]), atol=1e-6)


def test_tiles_multiply(spark, study):
    k1, k2, *_, kernels = study
    v = np.random.default_rng(6).normal(size=(40, 3))
    tiles = K.Tiles(kernels, ["k1", "k2"], 16)
    got = tiles.times(v)
    np.testing.assert_allclose(got["k1"], k1 @ v)
    np.testing.assert_allclose(got["k2"], k2 @ v)
    np.testing.assert_allclose(tiles.whole("k2"), k2)


def test_curve_without_factoring(spark, study):
    """The recurrences' quadratic forms are exact; the log determinant is a mean over probes, equal at all points."""
    k1, k2, c, y, people, kernels = study
    grid = [0.0, 0.5, 1.0]
    exact = {r["rg"]: r["loglkl"] for r in variance.correlation_curve(kernels, people, ["one", "cov"], grid).collect()}
    for g in grid:
        assert exact[g] == pytest.approx(variance.reml(k1 + g * k2, y, c)[0])
    rough = {r["rg"]: r["loglkl"] for r in variance.correlation_curve(kernels, people, ["one", "cov"], grid, tile=16, direct=0, probes=300).collect()}
    for g in grid:
        assert rough[g] == pytest.approx(exact[g], abs=0.7)
        assert rough[g] - rough[0.0] == pytest.approx(exact[g] - exact[0.0], abs=0.35)


def test_people_missing_from_a_side_are_left_out(spark, study):
    k1, k2, c, y, people, kernels = study
    some = people.where("indiv < 90").withColumn("y", F.when(F.col("indiv") != 6, F.col("y")))
    keep = [i for i in range(30) if i != 2]
    got = variance.correlation_curve(kernels, some, ["one", "cov"], [0.3]).first()["loglkl"]
    assert got == pytest.approx(variance.reml((k1 + 0.3 * k2)[np.ix_(keep, keep)], y[keep], c[keep])[0])


def test_sampling_covariance_of_moments(spark, study):
    k1, k2, c, y, people, kernels = study
    est, cov = variance.he_covariance(kernels, ["k1", "k2"], people, ["one", "cov"], tile=16, columns=7)
    p = np.eye(40) - c @ np.linalg.inv(c.T @ c) @ c.T
    g = [k @ p for k in (k1, k2, np.eye(40))]
    d = np.array([[(a * b).sum() for b in g] for a in g])
    theta = np.linalg.solve(d, [(p @ y) @ a @ (p @ y) for a in g])
    np.testing.assert_allclose(list(est.values()), theta)
    s = sum(t * a for t, a in zip(theta, g, strict=True))
    v = 2 * np.array([[((s @ a) * (s @ b)).sum() for b in g] for a in g])
    want = np.linalg.inv(d) @ v @ np.linalg.inv(d)
    np.testing.assert_allclose(cov, want)
    _, rough = variance.he_covariance(kernels, ["k1", "k2"], people, ["one", "cov"], tile=16, probes=600)
    np.testing.assert_allclose(np.diag(rough), np.diag(want), rtol=0.3)


def test_components_by_restricted_likelihood(spark, study):
    """One kernel: the maximum of ``reml``. Two: no neighbour has a higher likelihood; conjugate gradients give the same."""
    k1, k2, c, y, people, kernels = study
    one = variance.reml_components(kernels.drop("k2"), ["k1"], people, ["one", "cov"])["var"]
    _, vg, ve = variance.reml(k1, y, c)
    assert one["k1"] == pytest.approx(vg, rel=1e-3) and one["e"] == pytest.approx(ve, rel=1e-3)
    found = variance.reml_components(kernels, ["k1", "k2"], people, ["one", "cov"])

    def ll(a, b, e):
        v = a * k1 + b * k2 + e * np.eye(40)
        w = np.linalg.inv(v)
        m = c.T @ w @ c
        r = w - w @ c @ np.linalg.inv(m) @ c.T @ w
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(m)[1] + y @ r @ y)

    at = list(found["var"].values())
    best = ll(*at)
    assert all(ll(*(np.array(at) + d)) <= best + 1e-7 for d in 0.02 * np.vstack((np.eye(3), -np.eye(3))))
    each = lambda v: [k1 @ v, k2 @ v, v]
    b = np.random.default_rng(1).normal(size=(40, 3))
    np.testing.assert_allclose(variance.conjugate_gradients(each, np.array([0.5, 0.2, 0.3]), b), np.linalg.solve(0.5 * k1 + 0.2 * k2 + 0.3 * np.eye(40), b), rtol=1e-6)
    z = np.random.default_rng(2).choice([-1.0, 1.0], size=(40, 2000))
    rough, _, _ = variance.stochastic_components(each, y, c, z, 50, 1e-6)
    np.testing.assert_allclose(rough, at, atol=0.25)
    assert found["varcov"].shape == (3, 3) and variance.estimate(kernels, ["k1"], people, ["one"], "HE").keys() == {"k1", "e"}


@pytest.mark.parametrize("direct", [2048, 0])
def test_phenotypes_from_kernels(spark, study, direct):
    k1, *_, people, kernels = study
    got = simulate.from_kernels(kernels.drop("k2"), {"k1": 2.0, "e": 0.5}, people.select("indiv", "cov"), {"cov": 3.0}, n_sim=400, seed=3, tile=16, direct=direct).join(people, "indiv").toPandas()
    wide = got.assign(r=got.pheno - 3.0 * got["cov"]).pivot(index="indiv", columns="sim", values="r").to_numpy()
    want = 2.0 * k1 + 0.5 * np.eye(40)
    assert wide.shape == (40, 400) and np.abs(wide @ wide.T / 400 - want).max() < 6 * np.abs(want).max() / 20
    assert np.trace(wide @ wide.T / 400) == pytest.approx(np.trace(want), rel=0.05)


def test_spline_of_many_knots():
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(0, 1, 20_001))
    at = np.linspace(0.01, 0.99, 50)
    np.testing.assert_allclose(variance.not_a_knot(x, np.sin(9 * x), at), np.sin(9 * at), atol=1e-6)
    x = np.array([0.0, 0.3, 0.5, 1.1])
    np.testing.assert_allclose(variance.not_a_knot(x, x**3, np.array([0.2, 0.9])), [0.008, 0.729])


def test_kernels_are_made_once_for_moments(spark):
    kernels = spark.createDataFrame([(i, j, 1.0 if i == j else 0.25, 0.5 / (1 + i + j)) for i in range(6) for j in range(i + 1)], "i long, j long, k1 double, k2 double")
    people = spark.createDataFrame([(i, float(i * i % 7), 1.0) for i in range(6)], "indiv long, y double, one double")
    for got in variance.he_moments(kernels, ["k1", "k2"], people, ["one"]):
        assert got.inputFiles()
