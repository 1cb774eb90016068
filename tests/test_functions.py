"""Special functions, ranks, curves, meta-analysis, projection geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.functions import special, stats
from mosaica.operators import dataset, select


def test_tails():
    assert special.norm_sf(np.array([10.0]))[0] == pytest.approx(7.619853024160527e-24, rel=1e-10)
    np.testing.assert_allclose(special.chi2_sf(np.array([0.5, 3.0, 40.0]), 2), np.exp(-np.array([0.5, 3.0, 40.0]) / 2), rtol=1e-12)
    x = np.array([0.3, 2.0, 9.0])
    np.testing.assert_allclose(special.chi2_sf(x, 4), np.exp(-x / 2) * (1 + x / 2), rtol=1e-12)
    f, d2 = np.array([0.2, 1.5, 30.0]), np.array([7.0, 40.0, 500.0])
    np.testing.assert_allclose(special.f_sf(f, 2, d2), (1 + 2 * f / d2) ** (-d2 / 2), rtol=1e-10)
    # F(1, d) is the square of t; for one degree of freedom t is Cauchy.
    np.testing.assert_allclose(special.f_sf(np.array([3.0]), 1, np.array([1.0])), 1 - 2 / math.pi * math.atan(math.sqrt(3.0)), rtol=1e-10)
    assert special.norm_ppf(np.array([0.975, 0.0, 1.0])).tolist() == [pytest.approx(1.959963984540054), -math.inf, math.inf]


def test_ordering_over_ranges(spark):
    """Numbers, sums and average ranks over several ranges, with many ties and groups, as one sorted list gives them."""
    from mosaica.functions import ordering

    rng = np.random.default_rng(2)
    v = [None if i % 11 == 0 else float(x) for i, x in enumerate(rng.integers(0, 12, 300))]
    g = [None if x == 3 else int(x) for x in rng.integers(0, 4, 300)]
    df = spark.createDataFrame(list(zip(range(300), v, g, strict=True)), "id int, v double, g int").repartition(4)
    got = {r["id"]: r["n"] for r in ordering.dense_index(df, "id", "n", 7).collect()}
    assert got == {i: i for i in range(300)}
    sums = {r["id"]: (r["s"], r["b"]) for r in ordering.running_sum(ordering.running_sum(df, F.col("id"), ["id"], "s", parts=7), F.col("id"), ["id"], "b", False, 5).collect()}
    assert sums == {i: (i * (i + 1) // 2, i * (i - 1) // 2) for i in range(300)}
    for keys in ([], ["g"]):
        got = {r["id"]: r["r"] for r in ordering.average_rank(df, "v", "r", keys, 6).collect()}
        assert len(got) == 300
        for i in range(300):
            mates = sorted(x for x, k in zip(v, g, strict=True) if x is not None and (not keys or k == g[i]))
            assert got[i] == (None if v[i] is None else mates.index(v[i]) + 1 + (mates.count(v[i]) - 1) / 2)


def test_normal_scores(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, None), (4, 1.0), (5, 9.0)], "id int, v double")
    got = {r["id"]: r["v"] for r in stats.quantile_normalize(df, "v").collect()}
    assert got[3] is None and got[2] == got[4]
    assert got[5] == pytest.approx(special.norm_ppf(np.array([3.5 / 4]))[0])
    assert got[2] == pytest.approx(special.norm_ppf(np.array([(1.5 - 0.5) / 4]))[0])


def test_hdi(spark):
    x = np.linspace(0, 1, 21)
    ll = -(((x - 0.4) / 0.1) ** 2) / 2
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, ll, strict=True)], "t int, rg double, loglkl double")
    r = stats.hdi(df, ["t"], "rg", 0.95).collect()
    p = np.exp(ll) / np.exp(ll).sum()
    down = np.sort(p)[::-1]
    inside = x[p > down[np.argmax(np.cumsum(down) >= 0.95)]]
    assert len(r) == 1 and (r[0]["low"], r[0]["high"]) == (pytest.approx(inside[0]), pytest.approx(inside[-1]))
    spike = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, -100.0)], "t int, rg double, loglkl double")
    assert stats.hdi(spike, ["t"], "rg", 0.5).count() == 0


def test_meta_and_deming(spark):
    rng = np.random.default_rng(0)
    d, se = rng.normal(size=8), rng.uniform(0.2, 1, 8)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(d, se, strict=True)], "k int, effect double, se double")
    w = 1 / se**2
    m = (w * d).sum() / w.sum()
    q = (w * (d - m) ** 2).sum()
    tau2 = max(0, (q - 7) / (w.sum() - (w**2).sum() / w.sum()))
    w2 = 1 / (se**2 + tau2)
    r = stats.meta_analysis(df, ["k"]).first()
    assert (r["summary"], r["se"], r["tau2"]) == (pytest.approx((w2 * d).sum() / w2.sum()), pytest.approx(w2.sum() ** -0.5), pytest.approx(tau2))
    x = rng.normal(size=200)
    pts = spark.createDataFrame([(1, float(a), float(2 * a + 1), 0.1, 0.2) for a in x], "k int, x double, y double, sx double, sy double")
    r = stats.deming(pts, ["k"]).first()
    assert (r["slope"], r["intercept"]) == (pytest.approx(2), pytest.approx(1))
    r = stats.deming_weighted(pts, ["k"], rounds=8).first()
    assert (r["slope"], r["intercept"]) == (pytest.approx(2), pytest.approx(1))


def test_credible_set(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.5, 0.3, 0.15, 0.05])], "k int, snp int, posterior double")
    assert sorted(r["snp"] for r in stats.credible_set(df, ["k"], 0.9).collect()) == [0, 1, 2]


def test_projection_selects_the_middle(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "A", *map(float, rng.normal(-5, 0.5, 2))) for i in range(50)] + [(50 + i, "B", *map(float, rng.normal(5, 2, 2))) for i in range(50)] + [(100 + i, "SAMPLE", *map(float, rng.normal(0, 0.3, 2))) for i in range(30)]
    pcs = spark.createDataFrame(rows, "indiv int, pop string, pc1 double, pc2 double")
    got = select.admixed(pcs, ["pc1", "pc2"], ["A"], ["B"], t_range=(0.1, 0.9), max_dist=1.0).collect()
    assert len(got) == 30 and all(0.3 < r["t"] < 0.7 for r in got)


def test_info_must_agree(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "indiv int, x double")
    same = spark.createDataFrame([(1, 1.0 + 1e-12, 5), (2, None, 6)], "indiv int, x double, z int")
    assert dataset.append_info(a, same, "indiv").columns == ["indiv", "x", "z"]
    other = same.withColumn("x", F.lit(3.0))
    with pytest.raises(ValueError):
        dataset.append_info(a, other, "indiv")
    assert dataset.append_info(a, other, "indiv", force_update=True).agg(F.sum("x")).first()[0] == 6.0


def test_dummies_keep_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, g string")
    assert [tuple(r) for r in dataset.dummies(df, "g").orderBy("id").collect()] == [(1, 0, 0), (2, 1, 0), (3, None, None), (4, 0, 1)]


def test_lambda_interval_with_a_strong_locus(spark):
    x = np.random.default_rng(1).normal(size=4000) ** 2
    null = spark.createDataFrame(list(enumerate(x.tolist())), "snp long, chi2 double")
    strong = null.unionByName(spark.createDataFrame([(4000, 1e6)], null.schema))
    low, high = stats.lambda_gc_bootstrap(strong, "snp", resamples=99).first()
    # Order statistics about the median bound it as the bootstrap does.
    want = np.quantile(x, [0.5 - 0.98 / 4000**0.5, 0.5 + 0.98 / 4000**0.5]) / special.CHI2_MEDIAN
    np.testing.assert_allclose([low, high], want, atol=0.025)
