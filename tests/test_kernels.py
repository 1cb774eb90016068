"""Kernels, variance components and scores against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.operators import kernels as K
from mosaica.operators import linkage, scores, segments, variance


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    m, n = 30, 11
    a, c = rng.integers(0, 2, (m, n, 2)), rng.integers(0, 2, (m, n, 2))
    geno = spark.createDataFrame([(s, i, int(a[s, i, 0]), int(a[s, i, 1]), int(c[s, i, 0]), int(c[s, i, 1])) for s in range(m) for i in range(n)], "snp long, indiv long, a0 int, a1 int, c0 int, c1 int").cache()
    snps = spark.createDataFrame([(s, s // 10, s * 100) for s in range(m)], "snp long, chrom int, pos long")
    return a, c, geno, snps


def square(df, n, value, i="i", j="j"):
    out = np.full((n, n), np.nan)
    for r in df.collect():
        out[r[i], r[j]] = out[r[j], r[i]] = r[value]
    return out


@pytest.mark.parametrize("tile", [3, 4, 512])
def test_cross_products_over_tiles(spark, tile):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 25, 10))
    df = spark.createDataFrame([(0, f, e, float(x[f, e]), float(y[f, e])) for f in range(25) for e in range(10)], "block long, feature long, entity long, x double, y double")
    got = K.cross_products(df, ["x", "y"], tile).collect()
    assert len(got) == 55
    for r in got:
        i, j = r["i"], r["j"]
        np.testing.assert_allclose([r["x_x"], r["x_y"], r["y_x"], r["y_y"]], [x[:, i] @ x[:, j], x[:, i] @ y[:, j], y[:, i] @ x[:, j], y[:, i] @ y[:, j]], atol=1e-12)


def test_grm(panel):
    a, _, geno, _ = panel
    g = a.sum(axis=2).astype(float)
    z = (g - g.mean(axis=1, keepdims=True)) / g.std(axis=1, keepdims=True)
    np.testing.assert_allclose(square(K.grm(geno), 11, "value"), z.T @ z / len(g), atol=1e-10)


def test_admix_kernels_sum_to_dosage(panel):
    a, _, geno, _ = panel
    g = a.sum(axis=2).astype(float)
    k = K.admix_grm(geno, 2).withColumn("s", F.col("k1") + F.col("k2"))
    np.testing.assert_allclose(square(k, 11, "s"), g.T @ g / len(g), atol=1e-10)


def test_ld_with_covariates(spark, panel):
    a, c, geno, snps = panel
    x = np.random.default_rng(5).normal(size=11)
    cov = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "indiv long, x double")
    design = np.stack([np.ones(11), x], 1)
    proj = np.eye(11) - design @ np.linalg.inv(design.T @ design) @ design.T
    a1, a2 = [(np.where(c == k, a, 0).sum(axis=2)) @ proj for k in (0, 1)]
    for r in K.ancestry_ld(geno, snps, cov).collect():
        s, t = r["s"], r["t"]
        assert s // 10 == t // 10
        np.testing.assert_allclose([r["ld11"], r["ld22"], r["ld12"], r["ld21"]], [a1[s] @ a1[t] / 11, a2[s] @ a2[t] / 11, a1[s] @ a2[t] / 11, a2[s] @ a1[t] / 11], atol=1e-10)


def test_prune_keeps_no_linked_pair(panel):
    _, _, geno, snps = panel
    r2 = K.correlations(geno, snps).withColumn("r2", F.col("corr") * F.col("corr"))
    left = {r["snp"] for r in linkage.prune(r2, snps, least=0.2).collect()}
    bad = [1 for r in r2.where("r2 > 0.2").collect() if r["s"] in left and r["t"] in left]
    assert left and not bad


def test_haseman_elston(spark, panel):
    _, _, geno, _ = panel
    rng = np.random.default_rng(2)
    y, x = rng.normal(size=(2, 11))
    k = K.admix_grm(geno, 2)
    k1, k2 = square(k, 11, "k1"), square(k, 11, "k2")
    c = np.stack([np.ones(11), x], 1)
    p = np.eye(11) - c @ np.linalg.inv(c.T @ c) @ c.T
    mats = [m @ p for m in (k1, k2, np.eye(11))]
    design = np.array([[(u * v).sum() for v in mats] for u in mats])
    response = np.array([(p @ y) @ m @ (p @ y) for m in mats])
    people = spark.createDataFrame([(i, float(y[i]), 1.0, float(x[i])) for i in range(11)], "indiv long, y double, one double, x double")
    got = variance.he_regression(k, ["k1", "k2"], people, ["one", "x"])
    np.testing.assert_allclose(list(got.values()), np.linalg.solve(design, response), rtol=1e-6)


def test_reml_is_the_best_of_its_likelihood():
    rng = np.random.default_rng(4)
    n = 60
    z = rng.normal(size=(n, 80))
    k = z @ z.T / 80
    y = np.linalg.cholesky(0.6 * k + 0.4 * np.eye(n)) @ rng.normal(size=n)
    c = np.ones((n, 1))

    def loglik(vg, ve):
        v = vg * k + ve * np.eye(n)
        vi = np.linalg.inv(v)
        xvx = c.T @ vi @ c
        p = vi - vi @ c @ np.linalg.inv(xvx) @ c.T @ vi
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + y @ p @ y)

    _, vg, ve = variance.reml(k, y, c)
    best = loglik(vg, ve)
    assert all(best >= loglik(vg * u, ve * w) - 1e-6 for u in (0.9, 1, 1.1) for w in (0.9, 1, 1.1))


def test_spline_is_exact_on_cubics():
    x = np.linspace(0, 1, 7)
    f = lambda t: 2 * t**3 - t**2 + 0.5
    fine = np.linspace(0, 1, 101)
    np.testing.assert_allclose(variance.not_a_knot(x, f(x), fine), f(fine), atol=1e-10)


def test_partial_scores_sum_to_total(spark, panel):
    a, c, geno, _ = panel
    w = np.random.default_rng(6).normal(size=30)
    weights = spark.createDataFrame([(s, float(v)) for s, v in enumerate(w)], "snp long, weight double")
    total = {r["indiv"]: r["pgs"] for r in scores.total(geno, weights).collect()}
    for r in scores.partial(geno, weights, 2).collect():
        assert r["pgs1"] + r["pgs2"] == pytest.approx(total[r["indiv"]])
        assert total[r["indiv"]] == pytest.approx((a.sum(axis=2) * w[:, None]).sum(axis=0)[r["indiv"]])
    ref = spark.createDataFrame([(k, i, h, s, int(a[s, i, h])) for k in (0, 1) for i in range(3) for h in (0, 1) for s in range(30)], "anc int, ref long, ploidy int, snp long, allele int")
    for r in scores.reference_scores(segments.encode(geno), ref, weights).collect():
        mask = (c[:, r["indiv"], :] == r["anc"]).sum(axis=1)
        assert r["score"] == pytest.approx((mask * a[:, r["ref"], r["ploidy"]] * w).sum())
