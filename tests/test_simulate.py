"""Simulations against their distributions and plain Python; draws don't depend on partitions."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.functions.stats import lambda_gc_bootstrap
from mosaica.operators import simulate as S


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, *(int(x) for x in rng.integers(0, 2, 4))) for s in range(30) for i in range(50)]
    return rows, spark.createDataFrame(rows, "snp long, indiv long, a0 int, a1 int, c0 int, c1 int")


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select("id", S.uniform(3, "id").alias("u"), S.normal(4, "id").alias("z"))
    rows = sorted(df.collect())
    assert rows == sorted(spark.range(2000).repartition(7).select("id", S.uniform(3, "id").alias("u"), S.normal(4, "id").alias("z")).collect())
    u, z = np.array([r["u"] for r in rows]), np.array([r["z"] for r in rows])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.06


def test_haplotype_ancestry(spark):
    n, mosaic, props = 10_000, 500.0, [0.8, 0.2]
    got = S.haplotype_ancestry(spark, n, 400, mosaic, props, seed=2).toPandas()
    share, runs = 0, []
    for _, hap in got.groupby(["indiv", "ploidy"]):
        stop, anc = hap.stop.to_numpy(), hap.anc.to_numpy()
        assert stop[-1] == n and (np.diff(stop) > 0).all() and (anc[1:] != anc[:-1]).all()
        share += np.diff(np.concatenate(([0], stop)))[anc == 0].sum()
        runs.append(len(stop))
    assert len(runs) == 400
    assert share / (400 * n) == pytest.approx(0.8, abs=0.03)
    # A switch at a breakpoint has the chance 2 x 0.8 x 0.2.
    assert np.mean(runs) == pytest.approx(1 + 0.32 * n / mosaic, rel=0.1)


def test_copied_genotypes(spark):
    rng = np.random.default_rng(1)
    n_ref, n_snp = {0: 5, 1: 7}, 60
    ref = {(a, r): rng.integers(0, 2, n_snp) for a in n_ref for r in range(n_ref[a])}
    reference = spark.createDataFrame([(a, r, s, int(x)) for (a, r), hap in ref.items() for s, x in enumerate(hap)], "anc int, ref int, snp long, allele int")
    haps = S.haplotype_ancestry(spark, n_snp, 20, 15.0, [0.5, 0.5], seed=4)
    got = {(r["snp"], r["indiv"]): r for r in S.copy_genotypes(haps, reference, n_ref, seed=5).collect()}
    assert len(got) == n_snp * 10
    used = set()
    for (indiv, h), segments in haps.toPandas().groupby(["indiv", "ploidy"]):
        start = 0
        for stop, anc in zip(segments.stop, segments.anc, strict=True):
            alleles = [got[s, indiv][f"a{h}"] for s in range(start, stop)]
            assert all(got[s, indiv][f"c{h}"] == anc for s in range(start, stop))
            fits = [r for r in range(n_ref[anc]) if ref[anc, r][start:stop].tolist() == alleles]
            assert fits
            used.update((anc, fits[0]) for _ in range(len(fits) == 1))
            start = stop
    assert len(used) > 6


def test_independent_genotypes(spark):
    cells = [(s, i, (s + i) % 2, i % 2) for s in range(2) for i in range(3000)]
    freqs = spark.createDataFrame([(0, 0.1, 0.7), (1, 0.5, 0.0)], "snp long, f1 double, f2 double")
    got = S.independent_genotypes(spark.createDataFrame(cells, "snp long, indiv long, c0 int, c1 int"), freqs, seed=6).toPandas()
    assert sorted(zip(got.snp, got.indiv, got.c0, got.c1, strict=True)) == sorted(cells)
    for s, want in ((0, (0.1, 0.7)), (1, (0.5, 0.0))):
        for anc in (0, 1):
            drawn = np.concatenate([got[(got.snp == s) & (got[f"c{h}"] == anc)][f"a{h}"] for h in (0, 1)])
            assert drawn.mean() == pytest.approx(want[anc], abs=0.03)
    assert abs(np.corrcoef(got[got.snp == 0].a0, got[got.snp == 0].a1)[0, 1]) < 0.5


@pytest.mark.parametrize(("freq", "fst"), [(0.3, 0.1), (0.05, 0.2)])
def test_frequencies_follow_the_beta(spark, freq, fst):
    n = 6000
    got = S.balding_nichols(spark.range(n).select(F.col("id").alias("snp"), F.lit(freq).alias("freq")), fst, 2, seed=3).toPandas()
    scale = (1 - fst) / fst
    want = np.random.default_rng(0).beta(freq * scale, (1 - freq) * scale, 200_000)
    for f in ("f1", "f2"):
        assert got[f].mean() == pytest.approx(freq, abs=4 * want.std() / n**0.5)
        assert got[f].var() == pytest.approx(fst * freq * (1 - freq), rel=0.12)
        for q in (0.25, 0.5, 0.9):
            assert (got[f] <= np.quantile(want, q)).mean() == pytest.approx(q, abs=0.03)
    assert abs(np.corrcoef(got.f1, got.f2)[0, 1]) < 0.06
    ends = S.balding_nichols(spark.createDataFrame([(1, 0.0), (2, 1.0)], "snp long, freq double"), fst, 1).orderBy("snp")
    assert [r["f1"] for r in ends.collect()] == [0.0, 1.0]
    assert S.balding_nichols(spark.createDataFrame([(1, 0.4)], "snp long, freq double"), 0.0, 1).first()["f1"] == 0.4


def test_cases(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(2, 3, 5000)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "indiv long, pheno double")
    probit = S.binary(values, 0.2).orderBy("indiv").toPandas()
    assert probit.case.tolist() == ((x - x.mean()) / x.std() >= -NormalDist().inv_cdf(0.2)).astype(int).tolist()
    logit = S.binary(values, 0.1, "logit", seed=4).toPandas()
    assert logit.case.mean() == pytest.approx(0.1, abs=0.02)
    assert logit[logit.case == 1].pheno.mean() > logit[logit.case == 0].pheno.mean() + 2
    some = S.case_control(S.binary(values, 0.2), 0.5, seed=2).toPandas()
    cases = probit[probit.case == 1]
    assert sorted(some[some.case == 1].indiv) == sorted(cases.indiv)
    assert (some.case == 0).sum() == int(len(cases) * 0.5) and some.indiv.is_unique


def test_effects(spark):
    snps = spark.range(3000).withColumnRenamed("id", "snp")
    got = S.causal_effects(snps, 2000, 2, 0.6, seed=7).toPandas()
    assert got.snp.nunique() == 2000
    assert got.beta1.std() == pytest.approx(1, abs=0.06) and got.beta2.std() == pytest.approx(1, abs=0.06)
    assert np.corrcoef(got.beta1, got.beta2)[0, 1] == pytest.approx(0.6, abs=0.05)


def test_quantitative(spark, panel):
    rows, geno = panel
    snps = spark.range(30).withColumnRenamed("id", "snp")
    effects = S.causal_effects(snps, 10, 2, 0.5, seed=1)
    b = {r["snp"]: (r["beta1"], r["beta2"]) for r in effects.collect()}
    people = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "indiv long, age double")
    got = S.quantitative(geno, snps, 2, 0.4, 10, effects=effects, covariates=people, cov_effects={"age": 2.0}, seed=1).orderBy("indiv").toPandas()
    g = np.zeros(50)
    for s, i, a0, a1, c0, c1 in rows:
        if s in b:
            g[i] += a0 * b[s][c0] + a1 * b[s][c1]
    np.testing.assert_allclose(got.g, g * np.sqrt(0.4) / g.std())
    noise = got.pheno - got.g - 2.0 * (got.indiv % 3)
    assert 0.5 < noise.std() < 1.05 and abs(noise.mean()) < 0.4


def test_quantitative_of_one_population(spark, panel):
    _, geno = panel
    prior = spark.createDataFrame([(s, 0.0 if s else 4.0) for s in range(30)], "snp long, prior_var double")
    got = S.quantitative_1pop(geno, prior, 0.5, 30, seed=2).join(geno.where("snp = 0"), "indiv").toPandas()
    # Only variant 0 has an effect, so its dosage says all.
    dosage = got.a0 + got.a1
    assert abs(np.corrcoef(got.g, dosage)[0, 1]) == pytest.approx(1.0)
    assert got.g.std(ddof=0) == pytest.approx(np.sqrt(0.5))


@pytest.mark.parametrize("strong", [0.0, 2000.0])
def test_bootstrap_of_the_median(spark, strong):
    """Against resampling by index, also with one strong locus."""
    rng = np.random.default_rng(11)
    chi2 = np.append(rng.chisquare(1, 3000), strong)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(chi2)], "snp long, chi2 double")
    got = lambda_gc_bootstrap(df, "snp").first()
    medians = np.median(chi2[rng.integers(0, len(chi2), (3000, len(chi2)))], axis=1) / 0.4549364231195724
    low, high = np.quantile(medians, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.2 * (high - low) and abs(got["high"] - high) < 0.2 * (high - low)
