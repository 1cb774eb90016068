"""Ranks, likelihood curves, meta-analysis and other small statistics as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import average_rank
from .special import CHI2_MEDIAN, probit


def rank_fraction(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Add ``fraction`` = (average rank - 1/2) / n of the values that are present; null stays null."""
    keys = by or []
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    ranked = average_rank(df, value, "_rank", keys)
    if keys:
        same = ranked.alias("r").join(n.alias("n"), [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
        ranked = same.select("r.*", "n._n")
    else:
        ranked = ranked.crossJoin(F.broadcast(n))
    return ranked.withColumn("fraction", (F.col("_rank") - 0.5) / F.col("_n")).drop("_rank", "_n")


def quantile_normalize(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return rank_fraction(df, value, by).withColumn(value, probit(F.col("fraction"))).drop("fraction")


def curve_probability(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``prob``: the softmax of loglkl over each curve."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col("loglkl") - F.max("loglkl").over(w))
    return df.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def hdi(df: DataFrame, keys: list[str], x: str, ci: float) -> DataFrame:
    """keys, low, high: the intervals of highest density of each curve. Points whose probability is above the critical one
    (that at which the sorted sum reaches ``ci``) belong; runs of neighbouring points are intervals; none may be left."""
    p = curve_probability(df, keys)
    down = Window.partitionBy(*keys).orderBy(F.desc("prob"), x).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_c", F.sum("prob").over(down))
    crit = F.max(F.when(F.col("_c") >= ci, F.col("prob"))).over(Window.partitionBy(*keys))
    line = Window.partitionBy(*keys).orderBy(x)
    p = p.withColumn("_crit", crit).withColumn("_i", F.row_number().over(line)).where("prob > _crit")
    run = F.col("_i") - F.row_number().over(line)
    return p.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(x).alias("low"), F.max(x).alias("high")).drop("_run")


def mode(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(x, F.struct("loglkl", -F.col(x))).alias("mode"), F.max("loglkl").alias("loglkl"))


def credible_set(df: DataFrame, keys: list[str], coverage: float = 0.9) -> DataFrame:
    """The fewest rows of highest posterior that reach the coverage."""
    before = Window.partitionBy(*keys).orderBy(F.desc("posterior"), F.desc("snp")).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_b", F.coalesce(F.sum("posterior").over(before), F.lit(0.0))).where(F.col("_b") < coverage).drop("_b")


def posterior(df: DataFrame, keys: list[str], chi2: str = "chi2") -> DataFrame:
    """Add ``posterior``: exp(chi2 / 2) over its sum (a one-degree statistic is a squared z score)."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(chi2) / 2 - F.max(F.col(chi2) / 2).over(w))
    return df.withColumn("_e", e).withColumn("posterior", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def lambda_gc(df: DataFrame, chi2: str = "chi2", keys: list[str] | None = None) -> DataFrame:
    """Median statistic over the median of its null distribution."""
    return df.groupBy(*(keys or [])).agg((F.percentile(chi2, F.lit(0.5)) / CHI2_MEDIAN).alias("lambda_gc"))


def lambda_gc_bootstrap(df: DataFrame, key: str, chi2: str = "chi2", resamples: int = 499, bins: int = 4096, seed: int = 1) -> DataFrame:
    """low, high: 95 % percentile interval of lambda over resamples. A row's count in a resample is Poisson by hash (its
    limit for many rows), so resamples are grouped sums over bins of the statistic, not copies of the data in one place."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, "_b"), 11).cast("double") + 0.5) / float(1 << 53)
    cum, term, n = 0.36787944117144233, 0.36787944117144233, F.lit(0)
    for k in range(1, 8):
        n = n + (u > cum).cast("int")
        term /= k
        cum += term
    # Bins are laid between ranks 8 standard errors off the median, so no strong locus coarsens them; the rest is two bins.
    df = df.where(F.col(chi2).isNotNull())
    d = min(0.5, 4 / max(1, df.count()) ** 0.5 + 0.001)
    ends = df.agg(F.percentile_approx(chi2, [0.5 - d, 0.5 + d], 10_000).alias("_q")).select(F.sqrt(F.col("_q")[0]).alias("_lo"), F.sqrt(F.col("_q")[1]).alias("_hi"))
    place = F.floor(F.coalesce(F.try_divide(F.sqrt(chi2) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * (bins - 2))
    rows = df.crossJoin(F.broadcast(ends)).select(key, F.greatest(F.lit(-1), F.least(F.lit(bins - 2), place)).alias("_bin"), chi2)
    mean = rows.groupBy("_bin").agg(F.avg(chi2).alias("_x"))
    counted = rows.select(key, "_bin", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b")).withColumn("_n", n).groupBy("_b", "_bin").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("_b")
    acc = counted.join(mean, "_bin").withColumn("_c", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    median = acc.where(F.col("_c") >= F.col("_all") / 2).groupBy("_b").agg(F.min_by("_x", "_bin").alias("_m"))
    return median.agg((F.percentile("_m", F.lit(0.025)) / CHI2_MEDIAN).alias("low"), (F.percentile("_m", F.lit(0.975)) / CHI2_MEDIAN).alias("high"))


def meta_analysis(df: DataFrame, keys: list[str], method: str = "random", weight: str | None = None) -> DataFrame:
    """(effect, se) -> summary, se, q, tau2 of each key, fixed or DerSimonian-Laird random effects.

    Two aggregations: the fixed sums, then sums at weights that use tau2.
    """
    if method not in ("fixed", "random"):
        raise ValueError("method is fixed or random")
    d = df.withColumn("_v", F.col("se") * F.col("se")).where("_v > 0")
    w = 1 / F.col("_v")
    first = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * F.col("effect")).alias("_wd"))
    j = d.join(first, keys)
    q = j.groupBy(*keys, "_n", "_w", "_w2").agg(F.sum(F.pow(F.col("effect") - F.col("_wd") / F.col("_w"), 2) / F.col("_v")).alias("q"))
    spread = F.col("_w") - F.col("_w2") / F.col("_w")
    tau2 = F.greatest(F.lit(0.0), F.coalesce((F.col("q") - (F.col("_n") - 1)) / F.when((F.col("_n") > 1) & (spread > 0), spread), F.lit(0.0)))
    t = q.select(*keys, "q", tau2.alias("tau2"))
    j = d.join(t, keys)
    var = F.col("_v") + (F.col("tau2") if method == "random" else F.lit(0.0))
    wt = F.col(weight) if weight else 1 / var
    return j.groupBy(*keys).agg((F.sum(wt * F.col("effect")) / F.sum(wt)).alias("summary"), (F.sqrt(F.sum(wt * wt * var)) / F.sum(wt)).alias("se"), F.first("q").alias("q"), F.first("tau2").alias("tau2"))


def deming(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", ratio: float = 1.0, no_intercept: bool = False) -> DataFrame:
    """slope (and intercept) of errors-in-variables regression, in closed form for one ratio of error variances sy^2 / sx^2."""
    if no_intercept:
        sxx, syy, sxy = F.sum(F.col(x) * F.col(x)), F.sum(F.col(y) * F.col(y)), F.sum(F.col(x) * F.col(y))
    else:
        sxx, syy, sxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    m = df.groupBy(*keys).agg(sxx.alias("_xx"), syy.alias("_yy"), sxy.alias("_xy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    diff = F.col("_yy") - ratio * F.col("_xx")
    slope = F.when(F.col("_xy") != 0, (diff + F.sqrt(diff * diff + 4 * ratio * F.col("_xy") * F.col("_xy"))) / (2 * F.col("_xy")))
    out = m.withColumn("slope", slope)
    return out.select(*keys, "slope") if no_intercept else out.select(*keys, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def deming_weighted(df: DataFrame, keys: list[str], no_intercept: bool = False, rounds: int = 30) -> DataFrame:
    """slope (and intercept) of (x, y, sx, sy) with a different error on every point.

    For given errors the points' weights are 1 / (sy^2 + slope^2 sx^2); slope and
    weights are brought to agree by rounds of one aggregation over all points.
    """
    from ..operators.frames import cut

    state = df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))), F.lit(1.0)).alias("_b"), F.lit(0.0).alias("_a"))
    for _ in range(rounds):
        j = df.join(state, keys)
        w = 1 / (F.col("sy") * F.col("sy") + F.col("_b") * F.col("_b") * F.col("sx") * F.col("sx"))
        # Each point's place on the line, given the state; regressing on it keeps the estimate unbiased.
        xi = w * (F.col("sy") * F.col("sy") * F.col("x") + F.col("_b") * F.col("sx") * F.col("sx") * (F.col("y") - F.col("_a")))
        s = j.groupBy(*keys).agg(F.sum(w).alias("s"), F.sum(w * xi).alias("x"), F.sum(w * F.col("y")).alias("y"), F.sum(w * xi * xi).alias("xx"), F.sum(w * xi * F.col("y")).alias("xy"), F.sum(w * xi * F.col("x")).alias("xr"), F.sum(w * F.col("x")).alias("r"))
        if no_intercept:
            b, a = F.try_divide(F.col("xy"), F.col("xr")), F.lit(0.0)
        else:
            b = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("s"), F.col("xr") - F.col("x") * F.col("r") / F.col("s"))
            a = (F.col("y") - b * F.col("r")) / F.col("s")
        state = cut(s.select(*keys, b.alias("_b"), a.alias("_a")))
    return state.select(*keys, F.col("_b").alias("slope"), *([] if no_intercept else [F.col("_a").alias("intercept")]))


def heritability(est: DataFrame, scale: float = 1.0) -> DataFrame:
    """(vg, ve, v11, v12, v22) -> hsq and its variance by the delta method."""
    x, y = F.col("vg") * scale, F.col("ve")
    total = x + y
    g1, g2 = scale * y / (total * total), -x / (total * total)
    return est.withColumn("hsq", x / total).withColumn("hsq_var", g1 * g1 * F.col("v11") + 2 * g1 * g2 * F.col("v12") + g2 * g2 * F.col("v22"))


def quad_form(vector: DataFrame, matrix: DataFrame) -> DataFrame:
    """value = x' A x for vector (i, x) and matrix (i, j, a)."""
    left, right = vector.select("i", F.col("x").alias("_xi")), vector.select(F.col("i").alias("j"), F.col("x").alias("_xj"))
    return matrix.join(left, "i").join(right, "j").agg(F.sum(F.col("_xi") * F.col("a") * F.col("_xj")).alias("value"))


def likelihood_ratio(df: DataFrame, keys: list[str], x: str, at: Column) -> DataFrame:
    """keys, lrt: twice the log-likelihood of the mode less that at a point."""
    return df.groupBy(*keys).agg((2 * (F.max("loglkl") - F.max(F.when(at, F.col("loglkl"))))).alias("lrt"))


def qq(df: DataFrame, p: str = "p") -> DataFrame:
    """Add expected and observed -log10 p."""
    return rank_fraction(df, p).withColumn("expected", -F.log10("fraction")).withColumn("observed", -F.log10(p)).drop("fraction")


def manhattan(df: DataFrame) -> DataFrame:
    """(snp, chrom, pos, p) -> x (place in genome order), tick (middle place of its chromosome), y = -log10 p."""
    # Places inside a chromosome, and chromosomes' offsets: a row per chromosome is summed, not the genome.
    inner = F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "snp")) - 1
    n = df.groupBy("chrom").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select("chrom", "_n", offset.alias("_o"))
    out = df.withColumn("_i", inner).join(n, "chrom")
    return out.select("snp", "chrom", "pos", (F.col("_i") + F.col("_o")).alias("x"), (F.col("_o") + (F.col("_n") - 1) / 2).alias("tick"), (-F.log10("p")).alias("y"))
