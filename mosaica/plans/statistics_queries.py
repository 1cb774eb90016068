"""Queries of ranks, curves, meta-analysis and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as T
from ..operators import select as C
from ..sources import bridge as B
from .base import query, r6


@query("quantile_rank", "SELECT c_custkey AS id, round((rank() OVER (ORDER BY floor(c_acctbal / 10)) + (count(*) OVER (PARTITION BY floor(c_acctbal / 10)) - 1) / 2.0 - 0.5) / count(*) OVER (), 6) AS fraction FROM customer")
def quantile_rank(spark, d):
    v = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 10).alias("v"))
    return T.rank_fraction(v, "v").select("id", r6("fraction"))


_CURVE = "curve AS (SELECT n_regionkey AS trait, n_nationkey / 25.0 AS rg, -pow((n_nationkey - 7.0 - n_regionkey) / 5.0, 2) / 2 AS loglkl FROM nation)"


def curve(spark, d):
    """A likelihood curve per region over its nations' grid points."""
    return B.table(spark, d, "nation").select(F.col("n_regionkey").alias("trait"), (F.col("n_nationkey") / 25.0).alias("rg"), (-F.pow((F.col("n_nationkey") - 7.0 - F.col("n_regionkey")) / 5.0, F.lit(2)) / 2).alias("loglkl"))


@query(
    "hdi",
    f"""WITH {_CURVE}, e AS (SELECT *, exp(loglkl - max(loglkl) OVER (PARTITION BY trait)) AS e FROM curve), p AS (SELECT *, e / sum(e) OVER (PARTITION BY trait) AS prob FROM e),
       c AS (SELECT *, sum(prob) OVER (PARTITION BY trait ORDER BY prob DESC, rg ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY trait ORDER BY rg) AS i FROM p),
       k AS (SELECT *, max(CASE WHEN c >= 0.75 THEN prob END) OVER (PARTITION BY trait) AS crit FROM c), h AS (SELECT *, i - row_number() OVER (PARTITION BY trait ORDER BY rg) AS run FROM k WHERE prob > crit)
       SELECT trait, round(min(rg), 6) AS low, round(max(rg), 6) AS high FROM h GROUP BY trait, run""",
)
def hdi(spark, d):
    return T.hdi(curve(spark, d), ["trait"], "rg", 0.75).select("trait", r6("low"), r6("high"))


@query("rg_mode", f"WITH {_CURVE} SELECT trait, round(arg_max(rg, loglkl - rg * 1e-12), 6) AS mode, round(max(loglkl), 6) AS loglkl FROM curve GROUP BY trait")
def rg_mode(spark, d):
    return T.mode(curve(spark, d), ["trait"], "rg").select("trait", r6("mode"), r6("loglkl"))


@query("rg_lrt", f"WITH {_CURVE} SELECT trait, round(2 * (max(loglkl) - arg_max(loglkl, rg)), 6) AS lrt FROM curve GROUP BY trait")
def rg_lrt(spark, d):
    c = curve(spark, d)
    last = c.groupBy("trait").agg(F.max("rg").alias("_end"))
    return T.likelihood_ratio(c.join(last, "trait"), ["trait"], "rg", F.col("rg") == F.col("_end")).select("trait", r6("lrt"))


@query("loglkl_meta", "SELECT n_nationkey // 5 AS rg, round(sum(-pow((n_nationkey - 7.0) / 5.0, 2) / 2), 6) AS loglkl FROM nation GROUP BY ALL")
def loglkl_meta(spark, d):
    from ..operators.variance import sum_curves

    c = B.table(spark, d, "nation").select(F.expr("n_nationkey DIV 5").cast("int").alias("rg"), (-F.pow((F.col("n_nationkey") - 7.0) / 5.0, F.lit(2)) / 2).alias("loglkl"))
    return sum_curves(c).select("rg", r6("loglkl"))


_CHI2 = """chi AS (SELECT snp, chrom, pos, pow(covar_pop(g, pheno), 2) / (var_pop(g) * var_pop(pheno)) * count(*) AS chi2 FROM apa JOIN indivs USING (indiv) JOIN snps USING (snp) GROUP BY ALL HAVING var_pop(g) > 0)"""


def chi2(spark, d):
    """A one-degree statistic per variant: n times the squared correlation with the phenotype."""
    g = B.genotypes(spark, d).select("snp", "indiv", (F.col("a0") + F.col("a1")).alias("g")).join(B.individuals(spark, d).select("indiv", "pheno"), "indiv")
    s = g.groupBy("snp").agg(F.covar_pop("g", "pheno").alias("_c"), F.var_pop("g").alias("_v"), F.var_pop("pheno").alias("_y"), F.count("*").alias("_n")).where("_v > 0")
    return s.select("snp", (F.col("_c") * F.col("_c") / (F.col("_v") * F.col("_y")) * F.col("_n")).alias("chi2")).join(B.variants(spark, d).select("snp", "chrom", "pos"), "snp")


@query("lambda_gc", f"WITH {_CHI2} SELECT round(quantile_cont(chi2, 0.5) / 0.4549364231195724, 6) AS lambda_gc FROM chi")
def lambda_gc(spark, d):
    return T.lambda_gc(chi2(spark, d)).select(r6("lambda_gc"))


@query("lambda_gc_ci")
def lambda_gc_ci(spark, d):
    return T.lambda_gc_bootstrap(chi2(spark, d), "snp")


_POST = f"{_CHI2}, post AS (SELECT snp, chrom, exp(chi2 / 2 - m) / sum(exp(chi2 / 2 - m)) OVER (PARTITION BY chrom) AS posterior FROM (SELECT *, max(chi2 / 2) OVER (PARTITION BY chrom) AS m FROM chi))"


@query("posterior", f"WITH {_POST} SELECT snp, chrom, round(posterior, 6) AS posterior FROM post")
def posterior(spark, d):
    return T.posterior(chi2(spark, d), ["chrom"]).select("snp", "chrom", r6("posterior"))


@query("credible_set", f"WITH {_POST}, c AS (SELECT *, coalesce(sum(posterior) OVER (PARTITION BY chrom ORDER BY posterior DESC, snp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT snp, chrom, round(posterior, 9) AS posterior FROM post)) SELECT snp, chrom, round(posterior, 6) AS posterior FROM c WHERE b < 0.9")
def credible_set(spark, d):
    p = T.posterior(chi2(spark, d), ["chrom"]).select("snp", "chrom", r6("posterior", digits=9))
    return T.credible_set(p, ["chrom"]).select("snp", "chrom", r6("posterior"))


@query("manhattan_data", f"WITH {_CHI2}, n AS (SELECT chrom, count(*) AS n FROM chi GROUP BY chrom), o AS (SELECT chrom, n, coalesce(sum(n) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM n) SELECT snp, chrom, pos, CAST(row_number() OVER (PARTITION BY chrom ORDER BY pos, snp) - 1 + o AS BIGINT) AS x, round(o + (n - 1) / 2.0, 6) AS tick, round(-log10(exp(-chi2 / 2)), 6) AS y FROM chi JOIN o USING (chrom)")
def manhattan_data(spark, d):
    p = chi2(spark, d).withColumn("p", F.exp(-F.col("chi2") / 2))
    return T.manhattan(p).select("snp", "chrom", "pos", F.col("x").cast("long").alias("x"), r6("tick"), r6("y"))


@query("qq_data", f"WITH {_CHI2}, p AS (SELECT snp, round(exp(-chi2 / 2), 9) AS p FROM chi) SELECT snp, round(-log10((rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 - 0.5) / count(*) OVER ()), 6) AS expected, round(-log10(p), 6) AS observed FROM p")
def qq_data(spark, d):
    p = chi2(spark, d).select("snp", r6(F.exp(-F.col("chi2") / 2), "p", 9))
    return T.qq(p).select("snp", r6("expected"), r6("observed"))


@query("compare_pval_slope", f"WITH {_CHI2} SELECT round(sum(x * y) / sum(x * x), 6) AS slope FROM (SELECT chi2 / 2 / ln(10) AS x, sqrt(chi2) AS y FROM chi)")
def compare_pval_slope(spark, d):
    from ..plotdata import through_origin

    return through_origin(chi2(spark, d).select((F.col("chi2") / 2 / F.log(F.lit(10.0))).alias("x"), F.sqrt("chi2").alias("y"))).select(r6("slope"))


_EFFECTS = "eff AS (SELECT l_suppkey % 10 AS study, l_suppkey AS k, avg(l_discount * 100) AS effect, stddev_samp(l_discount * 100) / sqrt(count(*)) AS se, avg(l_tax * 100) AS y FROM lineitem GROUP BY l_suppkey HAVING stddev_samp(l_discount) > 0)"


def effects(spark, d):
    t = B.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg(F.col("l_discount") * 100).alias("effect"), (F.stddev_samp(F.col("l_discount") * 100) / F.sqrt(F.count("*"))).alias("se"), F.avg(F.col("l_tax") * 100).alias("y"))
    return t.where("se > 0").withColumn("study", F.col("l_suppkey") % 10)


def _meta(method: str) -> str:
    tau = "CASE WHEN n > 1 THEN greatest(0, (q - (n - 1)) / (w - w2 / w)) ELSE 0 END" if method == "random" else "0"
    return f"""WITH {_EFFECTS}, f AS (SELECT study, count(*) AS n, sum(1 / se / se) AS w, sum(1 / pow(se, 4)) AS w2, sum(effect / se / se) / sum(1 / se / se) AS m FROM eff GROUP BY study),
       q AS (SELECT f.*, sum(pow(effect - m, 2) / se / se) AS q FROM f JOIN eff USING (study) GROUP BY ALL), t AS (SELECT *, {tau} AS tau2 FROM q)
       SELECT study, round(sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)), 6) AS summary, round(sqrt(1 / sum(1 / (se * se + tau2))), 6) AS se, round(any_value(q), 5) AS q FROM t JOIN eff USING (study) GROUP BY study"""


@query("meta_fixed", _meta("fixed"))
def meta_fixed(spark, d):
    return T.meta_analysis(effects(spark, d), ["study"], "fixed").select("study", r6("summary"), r6("se"), r6("q", digits=5))


@query("meta_random", _meta("random"))
def meta_random(spark, d):
    return T.meta_analysis(effects(spark, d), ["study"], "random").select("study", r6("summary"), r6("se"), r6("q", digits=5))


@query("deming", f"WITH {_EFFECTS}, m AS (SELECT study, var_pop(effect) AS xx, var_pop(y) AS yy, covar_pop(effect, y) AS xy, avg(effect) AS mx, avg(y) AS my FROM eff GROUP BY study) SELECT study, round((yy - xx + sqrt(pow(yy - xx, 2) + 4 * xy * xy)) / (2 * xy), 5) AS slope, round(my - (yy - xx + sqrt(pow(yy - xx, 2) + 4 * xy * xy)) / (2 * xy) * mx, 5) AS intercept FROM m WHERE xy <> 0")
def deming(spark, d):
    return T.deming(effects(spark, d), ["study"], "effect", "y").where("slope IS NOT NULL").select("study", r6("slope", digits=5), r6("intercept", digits=5))


@query("hsq_delta", "WITH e AS (SELECT p_partkey AS id, p_size / 50.0 AS vg, 1 - p_size / 80.0 AS ve, 0.01 * p_size AS v11, -0.002 * p_size AS v12, 0.02 AS v22 FROM part) SELECT id, round(vg * 2 / (vg * 2 + ve), 6) AS hsq, round(pow(2 * ve / pow(vg * 2 + ve, 2), 2) * v11 + 2 * (2 * ve / pow(vg * 2 + ve, 2)) * (-2 * vg / pow(vg * 2 + ve, 2)) * v12 + pow(2 * vg / pow(vg * 2 + ve, 2), 2) * v22, 6) AS hsq_var FROM e")
def hsq_delta(spark, d):
    e = B.table(spark, d, "part").selectExpr("p_partkey AS id", "CAST(p_size / 50.0D AS DOUBLE) AS vg", "1 - p_size / 80.0D AS ve", "0.01D * p_size AS v11", "-0.002D * p_size AS v12", "0.02D AS v22")
    return T.heritability(e, 2.0).select("id", r6("hsq"), r6("hsq_var"))


_DIMS = ["x1", "x2", "x3", "x4"]
_POINTS = "pts AS (SELECT vec_id AS indiv, label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, CAST(embedding[3] AS DOUBLE) AS x3, CAST(embedding[4] AS DOUBLE) AS x4 FROM embeddings)"


def points(spark, d):
    return B.table(spark, d, "embeddings").select(F.col("vec_id").alias("indiv"), "label", *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(4)])


@query("distance_to_line", f"WITH {_POINTS}, t AS (SELECT *, (x1 + x2 * 2 - x3 + x4 * 0.5) / (1 + 4 + 1 + 0.25) AS t FROM pts) SELECT indiv, round(t, 6) AS t, round(sqrt(pow(x1 - t, 2) + pow(x2 - 2 * t, 2) + pow(x3 + t, 2) + pow(x4 - 0.5 * t, 2)), 6) AS dist FROM t")
def distance_to_line(spark, d):
    a, b = [F.lit(0.0)] * 4, [F.lit(x) for x in (1.0, 2.0, -1.0, 0.5)]
    return C.to_line(points(spark, d), _DIMS, a, b).select("indiv", r6("t"), r6("dist"))


def _refpop(where: str) -> str:
    s = lambda f: " + ".join(f.format(x=x) for x in _DIMS)
    cent = ", ".join(f"avg({x}) FILTER (label = 1) AS a{x}, avg({x}) FILTER (label = 5) AS b{x}" for x in _DIMS)
    return f"""WITH {_POINTS}, c AS (SELECT {cent} FROM pts), t AS (SELECT pts.*, c.*, ({s('({x} - a{x}) * (b{x} - a{x})')}) / ({s('pow(b{x} - a{x}, 2)')}) AS t FROM pts, c),
       e AS (SELECT *, sqrt({s('pow({x} - a{x} - t * (b{x} - a{x}), 2)')}) AS r FROM t), m AS (SELECT max(r) FILTER (label = 1) AS m1, max(r) FILTER (label = 5) AS m2 FROM e)
       SELECT indiv, round(t, 6) AS t, round(r / (m1 * (1 - t) + m2 * t), 6) AS dist FROM e, m WHERE label NOT IN (1, 5){where}"""


@query("distance_refpop", _refpop(""))
def distance_refpop(spark, d):
    p = points(spark, d)
    return C.to_reference(p.where("label NOT IN (1, 5)"), p.where("label = 1"), p.where("label = 5"), _DIMS).select("indiv", r6("t"), r6("dist"))


@query("select_admixed", _refpop(" AND t > 0.05 AND t < 0.95 AND r / (m1 * (1 - t) + m2 * t) < 1.5"))
def select_admixed(spark, d):
    pops = points(spark, d).select("indiv", F.when(F.col("label").isin(1, 5), F.concat(F.lit("POP"), F.col("label"))).otherwise("SAMPLE").alias("pop"), *_DIMS)
    return C.admixed(pops, _DIMS, ["POP1"], ["POP5"]).select("indiv", r6("t"), r6("dist"))
