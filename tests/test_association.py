"""Association against numpy least squares and maximum likelihood, with missing alleles and covariates."""

import numpy as np
import pytest

from mosaica.functions.special import chi2_sf, f_sf
from mosaica.operators import association as A
from mosaica.operators import alleles

N, M, K = 60, 12, 2


@pytest.fixture(scope="module")
def study():
    rng = np.random.default_rng(1)
    c = rng.integers(0, K, (M, N, 2))
    a = (rng.random((M, N, 2)) < 0.2 + 0.4 * c).astype(float)
    a[3, [0, 2], :] = np.nan
    a[5, [0, 2], :] = np.nan
    a[7] = 1.0  # constant
    cov = rng.normal(size=N)
    y = 0.8 * np.nansum(a[0], axis=1) + 0.3 * cov + rng.normal(size=N)
    return a, c, cov, y, (y > np.median(y)).astype(int)


@pytest.fixture(scope="module")
def frames(spark, study):
    a, c, cov, y, b = study
    num = lambda v: None if np.isnan(v) else int(v)
    geno = spark.createDataFrame([(s, i, num(a[s, i, 0]), num(a[s, i, 1]), int(c[s, i, 0]), int(c[s, i, 1])) for s in range(M) for i in range(N)], "snp long, indiv long, a0 int, a1 int, c0 int, c1 int").cache()
    indivs = spark.createDataFrame([(i, float(y[i]), float(cov[i]), int(b[i])) for i in range(N)], "indiv long, y double, x double, b int")
    return geno, indivs


def design(a, c, s, method):
    with np.errstate(invalid="ignore"):
        g = [np.where(c[s] == k, a[s], 0).sum(axis=1) for k in range(K)]
    lanc = [(c[s] == k).sum(axis=1).astype(float) for k in range(K - 1)]
    total = a[s].sum(axis=1)
    variables = {"ATT": [total], "SNP1": [total, *lanc], "TRACTOR": [*g, *lanc], "JOINT": [*g, *lanc], "ASE": g, "ADM": lanc, "HET": g}[method]
    return np.stack(variables, 1), total


@pytest.mark.parametrize("method", A.METHODS)
@pytest.mark.parametrize("covariates", [[], ["x"]])
def test_linear(frames, study, method, covariates):
    a, c, cov, y, _ = study
    got = {r["snp"]: r for r in A.linear(*frames, "y", K, method, covariates).collect()}
    assert len(got) == M
    _, tested = A.design(method, K)
    for s in range(M):
        v, total = design(a, c, s, method)
        keep = np.isfinite(v).all(axis=1) & (np.isfinite(total) | (method == "ADM"))
        base = np.ones((N, 1)) if not covariates else np.stack([np.ones(N), cov], 1)
        x, yy = np.hstack([base, v])[keep], y[keep]
        assert got[s]["N"] == keep.sum()
        if np.linalg.matrix_rank(x) < x.shape[1]:
            assert got[s]["P"] is None
            continue
        rss = lambda z: ((yy - z @ np.linalg.lstsq(z, yy, rcond=None)[0]) ** 2).sum()
        full = rss(x)
        if method == "HET":
            stat = keep.sum() * np.log(rss(np.hstack([base, total[:, None]])[keep]) / full)
            p = chi2_sf(np.array([stat]), K - 1)[0]
        else:
            q, d2 = len(tested), keep.sum() - x.shape[1]
            stat = (rss(np.delete(x, [base.shape[1] + t for t in tested], axis=1)) - full) / q / (full / d2)
            p = f_sf(np.array([stat]), q, np.array([d2]))[0]
        np.testing.assert_allclose([got[s]["STAT"], got[s]["P"]], [stat, p], rtol=1e-7, atol=1e-12)


def test_missing_alleles_change_only_their_variants(spark, frames):
    geno, indivs = frames
    whole = {r["snp"]: r["P"] for r in A.linear(geno.na.fill(0), indivs, "y", K, "ATT").collect()}
    holed = {r["snp"]: r["P"] for r in A.linear(geno, indivs, "y", K, "ATT").collect()}
    assert {s for s in whole if whole[s] != holed[s]} == {3, 5}


@pytest.mark.parametrize(("method", "most"), [("ATT", 500_000), ("TRACTOR", 500_000), ("HET", 500_000), ("TRACTOR", 0)])
def test_logistic(frames, study, method, most):
    a, c, cov, _, b = study
    got = {r["snp"]: r for r in A.logistic(*frames, "b", K, method, ["x"], most).collect()}

    def fit(x, y):
        w = np.zeros(x.shape[1])
        for _ in range(50):
            mu = 1 / (1 + np.exp(-x @ w))
            w = w + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
        eta = x @ w
        return (y * eta - np.logaddexp(0, eta)).sum()

    for s in (0, 1, 3):
        v, total = design(a, c, s, method)
        keep = np.isfinite(total)
        base = np.stack([np.ones(N), cov], 1)
        null = total[:, None] if method == "HET" else v[:, len(A.design(method, K)[1]) :]
        stat = 2 * (fit(np.hstack([base, v])[keep], b[keep]) - fit(np.hstack([base, null])[keep], b[keep]))
        assert got[s]["STAT"] == pytest.approx(stat, abs=1e-4)


def test_bad_phenotype_and_method(frames):
    with pytest.raises(ValueError):
        A.logistic(*frames, "y", K).collect()
    with pytest.raises(ValueError):
        A.linear(*frames, "y", K, "NONE")


def test_allele_per_anc_example(spark):
    geno = spark.createDataFrame([(0, 0, 0, 1, 0, 0), (0, 1, 1, 1, 0, 0), (0, 2, 0, 0, 0, 0)], "snp long, indiv long, a0 int, a1 int, c0 int, c1 int")
    assert [(r["g1"], r["g2"]) for r in alleles.allele_per_anc(geno, 2).orderBy("indiv").collect()] == [(1, 0), (2, 0), (0, 0)]


def test_missing_allele_poisons_its_cell(spark):
    geno = spark.createDataFrame([(0, 0, None, 1, 0, 1), (0, 1, 1, 1, 0, 0)], "snp long, indiv long, a0 int, a1 int, c0 int, c1 int")
    got = {r["anc"]: (r["af"], r["n_haplo"]) for r in alleles.af_per_anc(geno, 3).collect()}
    assert got == {0: (None, 3), 1: (1.0, 1), 2: (None, 0)}


def test_logistic_gathers_no_people(frames, study, monkeypatch):
    """Estimates as from all of a variant's rows at once, though no row holds them; a constant variant has none."""
    a, c, cov, _, b = study
    geno, indivs = frames

    def refuse(*_):
        raise AssertionError("a variant's people in one row")

    monkeypatch.setattr(A.F, "collect_list", refuse)
    got = {r["snp"]: r for r in A.logistic(geno, indivs, "b", K, "ATT", ["x"], most=0).collect()}
    assert len(got) == M and got[7]["P"] is None and got[7]["N"] == N
    for s in (0, 1, 3):
        v, _ = design(a, c, s, "ATT")
        keep = np.isfinite(v[:, 0])
        x, y = np.hstack([np.ones((N, 1)), (cov - cov.mean())[:, None], v])[keep], b[keep]
        w = np.zeros(3)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-x @ w))
            h = x.T @ (x * (mu * (1 - mu))[:, None])
            w = w + np.linalg.solve(h, x.T @ (y - mu))
        assert got[s]["N"] == keep.sum()
        np.testing.assert_allclose([got[s]["G_BETA"], got[s]["G_SE"]], [w[2], np.sqrt(np.linalg.inv(h)[2, 2])], rtol=1e-3)


@pytest.mark.parametrize("method", A.METHODS)
def test_logistic_in_one_pass_equals_its_steps(spark, frames, study, method):
    """Every number of both ways, with blocks of two variants, ids far apart, people without a phenotype and genotypes of strangers."""
    geno, indivs = frames
    far = lambda df: df.withColumn("indiv", A.F.col("indiv") * 37 + 5)
    some = far(indivs).withColumn("b", A.F.when(A.F.col("indiv") != 42, A.F.col("b"))).where("indiv <> 79")
    one = {r["snp"]: r for r in A.logistic(far(geno), some, "b", K, method, ["x"]).collect()}
    steps = {r["snp"]: r for r in A.logistic(far(geno), some, "b", K, method, ["x"], most=0).collect()}
    assert one.keys() == steps.keys() and len(one) == M
    for s, r in one.items():
        want = steps[s]
        assert r["N"] == want["N"] and [v is None for v in r] == [v is None for v in want]
        np.testing.assert_allclose([v for v in r if v is not None], [v for v in want if v is not None], rtol=1e-6, atol=1e-8)


def test_logistic_in_small_blocks_without_rows(spark, frames):
    geno, indivs = frames
    people = A.prepared(indivs, "b", ["x"]).drop("y").join(indivs.select("indiv", A.F.col("b").cast("double").alias("y")), "indiv")
    need = {"G": dict(A.columns(K))["G"]}
    whole = sorted(map(tuple, A.one_pass(geno, people, need, ["x0", "x1", "G"], ["x0", "x1"]).drop("beta", "se").collect()))
    small = sorted(map(tuple, A.one_pass(geno.repartition(5), people, need, ["x0", "x1", "G"], ["x0", "x1"], cells=130).drop("beta", "se").collect()))
    assert len(whole) == M
    np.testing.assert_allclose(np.array(small), np.array(whole), rtol=1e-9)
    assert not A.one_pass(geno.where("false"), people, need, ["x0", "G"], ["x0"]).collect()
    assert not A.one_pass(geno, people.where("false"), need, ["x0", "G"], ["x0"]).collect()


def test_people_and_means_go_to_the_panel(spark):
    from mosaica.operators.alleles import impute_mean

    geno = spark.createDataFrame([(s, i, None if s == i else (s + i) % 2, i % 2, 0, 1) for s in range(4) for i in range(6)], "snp long, indiv long, a0 int, a1 int, c0 int, c1 int")
    people = spark.createDataFrame([(i, float(i % 4)) for i in range(6)], "indiv long, pheno double")
    g = geno.selectExpr("snp", "indiv", "CAST(a0 + a1 AS DOUBLE) AS g")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = A.sufficient(geno, A.prepared(people, "pheno", []), 2, 0)[0]
        filled = impute_mean(g)
        for df in (sums, filled):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        few = A.sufficient(geno, A.prepared(people, "pheno", []), 2, 0, most=1)[0]
        assert sorted(map(str, few.collect())) == sorted(map(str, sums.collect()))
        assert sorted(map(str, impute_mean(g, most=1).collect())) == sorted(map(str, filled.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
