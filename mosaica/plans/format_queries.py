"""Queries of formats (written and read back), numbering, plot data, and operators that other queries use inside."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import plotdata
from ..functions import ordering, special, stats
from ..operators import dataset, kernels, scores, segments, simulate, variance
from ..operators.frames import checkpoint_folder
from ..sources import bridge as B
from ..sources import lanc, results, store, text
from .base import query, r6
from .variance_queries import kernels as _kernels
from .variance_queries import people


def _path(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


_V = "CAST(row_number() OVER (ORDER BY snp) - 1 AS BIGINT)"
_I = "CAST(row_number() OVER (ORDER BY indiv) - 1 AS BIGINT)"


@query("pvar_round_trip", f"SELECT {_V} AS snp, 'rs' || snp AS id, chrom, pos, ref, alt, brand FROM snps")
def pvar_round_trip(spark, d):
    path = _path(spark, "pvar")
    results.write_variants(B.variants(spark, d).select("snp", F.concat(F.lit("rs"), "snp").alias("id"), "chrom", "pos", "ref", "alt", "brand"), path)
    return text.variants(spark, path)


@query("psam_round_trip", f"SELECT {_I} AS indiv, name AS id, pop, superpop FROM indivs")
def psam_round_trip(spark, d):
    path = _path(spark, "psam")
    results.write_samples(B.individuals(spark, d).select("indiv", F.col("name").alias("id"), "pop", "superpop"), path)
    return text.samples(spark, path)


@query("export_panel", f"SELECT CAST(snp - (SELECT min(snp) FROM snps) AS BIGINT) AS snp, CAST(indiv - (SELECT min(indiv) FROM indivs) AS BIGINT) AS indiv, a0, a1, c0, c1 FROM geno")
def export_panel(spark, d):
    """The bridge panel written as interchange tables and read back."""
    p = B.panel(spark, d)
    prefix = _path(spark, "panel")
    snps, indivs = p.snps.select("snp", F.col("snp").cast("string").alias("id"), "chrom", "pos", "ref", "alt"), p.indivs.select("indiv", F.col("name").alias("id"))
    store.export(type(p)(p.geno, snps, indivs, 2), prefix)
    return store.from_files(spark, f"{prefix}.pvar", f"{prefix}.psam", f"{prefix}.lanc", spark.read.parquet(f"{prefix}.alleles")).geno.select("snp", "indiv", "a0", "a1", "c0", "c1")


@query("lanc_round_trip", f"SELECT dense_rank() OVER (ORDER BY indiv) - 1 AS indiv, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, anc0, anc1 FROM segs")
def lanc_round_trip(spark, d):
    path = _path(spark, "lanc")
    breaks = segments.encode(B.genotypes(spark, d)).select("indiv", "stop", "anc0", "anc1")
    n = B.variants(spark, d).agg(F.max("snp")).first()[0] + 1
    lanc.write(segments.with_starts(breaks), n, path)
    return lanc.read(spark, path)[0]


@query("vcf_read", "SELECT pos, chrom, CAST(indiv AS VARCHAR) AS id, a0, a1 FROM geno JOIN snps USING (snp)")
def vcf_read(spark, d):
    """Genotypes of the bridge panel written as phased calls and read back."""
    path = _path(spark, "vcf")
    people = [str(r[0]) for r in B.individuals(spark, d).select("indiv").orderBy("indiv").collect()]  # a sample's name is a column of the format
    calls = B.genotypes(spark, d).groupBy("snp").agg(F.sort_array(F.collect_list(F.struct("indiv", F.concat_ws("|", "a0", "a1").alias("g")))).alias("g"))
    line = F.concat_ws("\t", "chrom", "pos", F.col("snp").cast("string"), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("R2=0.9;MAF=0.1"), F.lit("GT"), F.array_join(F.transform("g", lambda x: x["g"]), "\t"))
    body = calls.join(B.variants(spark, d), "snp").select(F.col("snp").alias("o"), line.alias("value"))
    head = spark.createDataFrame([(-2, "##fileformat=VCFv4.2"), (-1, "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + people))], "o long, value string")
    head.unionByName(body).orderBy("o").coalesce(1).select("value").write.text(path)
    v, g = text.vcf(spark, path)
    return g.join(v.select("snp", "chrom", "pos"), "snp").select("pos", "chrom", g["id"], "a0", "a1")


@query("info_attach", "SELECT snp, chrom, size, 2 * size AS twice FROM snps")
def info_attach(spark, d):
    path = _path(spark, "info")
    text.write_table(B.variants(spark, d).select("snp", (2 * F.col("size")).alias("twice")), path)
    extra = text.info(spark, path, "snp").select(F.col("snp").cast("long").alias("snp"), F.col("twice").cast("int").alias("twice"))
    return text.attach_info(B.variants(spark, d).select("snp", "chrom", "size"), extra, "snp")


@query("info_update", "SELECT snp, CAST(size + snp % 2 AS INT) AS size FROM snps")
def info_update(spark, d):
    v = B.variants(spark, d)
    return dataset.append_info(v.select("snp", "size"), v.select("snp", (F.col("size") + F.col("snp") % 2).cast("int").alias("size")), "snp", force_update=True).select("snp", "size")


@query("info_differences", "SELECT 'size' AS column, CAST(count(*) FILTER (snp % 2 = 1) AS BIGINT) AS n_differ FROM snps")
def info_differences(spark, d):
    v = B.variants(spark, d)
    out = dataset.same_values(v.select("snp", "size"), v.select("snp", (F.col("size") + F.col("snp") % 2).cast("int").alias("size")), "snp", ["size"])
    return out.toDF("column", "n_differ").select("column", F.col("n_differ").cast("long").alias("n_differ"))


@query("panel_where", "SELECT g.* FROM geno g JOIN snps s USING (snp) JOIN indivs i USING (indiv) WHERE s.size > 25 AND i.superpop = 'ASIA'")
def panel_where(spark, d):
    return B.panel(spark, d).where_snps("size > 25").where_indivs("superpop = 'ASIA'").geno


@query("panel_by_ids", "SELECT * FROM geno WHERE snp IN (SELECT snp FROM snps WHERE chrom = 1)")
def panel_by_ids(spark, d):
    return B.panel(spark, d).select_ids("snp", B.variants(spark, d).where("chrom = 1").select("snp")).geno


@query("dense_numbering", "SELECT o_orderkey AS k, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS n FROM orders")
def dense_numbering(spark, d):
    return ordering.dense_index(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", "n")


@query("running_total", "SELECT o_orderkey AS k, CAST(sum(o_orderkey % 7) OVER (ORDER BY o_orderkey) AS BIGINT) AS s FROM orders")
def running_total(spark, d):
    return ordering.running_sum(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), F.col("k") % 7, ["k"], "s")


@query("rank_in_groups", "SELECT s_suppkey AS id, s_nationkey AS g, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2 AS DOUBLE) AS r FROM supplier")
def rank_in_groups(spark, d):
    s = B.table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS g", "s_acctbal AS v")
    return ordering.average_rank(s, "v", "r", ["g"]).select("id", "g", F.col("r").cast("double").alias("r"))


@query("chi2_tail", "SELECT snp, round(size / 2.0, 8) AS two, round(size / 2.0 - ln(1 + size / 2.0), 8) AS four FROM snps")
def chi2_tail(spark, d):
    """Negative logarithms of upper tails, which are in closed form for even degrees of freedom."""
    out = [r6(F.abs(special.chi2_to_log_pval(F.col("size").cast("double"), k)), n, 8) for k, n in ((2, "two"), (4, "four"))]
    return B.variants(spark, d).select("snp", *out)


@query("tail_round_trip", "SELECT snp, CAST(size AS DOUBLE) / 10 AS z, CAST(size AS DOUBLE) / 10 AS again FROM snps")
def tail_round_trip(spark, d):
    """A z score to its one-sided p value and back."""
    v = B.variants(spark, d).select("snp", (F.col("size").cast("double") / 10).alias("z"))
    return v.withColumn("p", special.z_to_pval(F.col("z"), False)).select("snp", "z", F.round(special.pval_to_z(F.col("p")), 6).alias("again"))


@query("chi2_round_trip", "SELECT snp, round(pow(size / 10.0, 2), 5) AS chi2 FROM snps")
def chi2_round_trip(spark, d):
    v = B.variants(spark, d).withColumn("p", special.z_to_pval(F.col("size").cast("double") / 10))
    return v.select("snp", F.round(special.pval_to_chi2(F.col("p")), 5).alias("chi2"))


@query("pgs_by_haplotype", "SELECT indiv, round(sum((a0 * CAST(c0 = 0 AS INT) + a1 * CAST(c1 = 0 AS INT)) * weight), 6) AS anc1, round(sum((a0 * c0 + a1 * c1) * weight), 6) AS anc2 FROM geno JOIN snps USING (snp) GROUP BY indiv")
def pgs_by_haplotype(spark, d):
    return scores.by_haplotype(B.genotypes(spark, d), B.variants(spark, d).select("snp", "weight"), 2).select("indiv", r6("anc1"), r6("anc2"))


@query("haplotype_breaks", "SELECT indiv, ploidy, stop, anc FROM (SELECT indiv, ploidy, snp + 1 AS stop, anc, lead(anc) OVER (PARTITION BY indiv, ploidy ORDER BY snp) AS nxt FROM haps) WHERE nxt IS NULL OR nxt <> anc")
def haplotype_breaks(spark, d):
    return segments.haplotype_segments(B.genotypes(spark, d))


@query("residual_alleles", "SELECT snp, indiv, round(g1 - avg(g1) OVER w - regr_slope(g1, cov) OVER w * (cov - avg(cov) OVER w), 6) AS a1, round(g2 - avg(g2) OVER w - regr_slope(g2, cov) OVER w * (cov - avg(cov) OVER w), 6) AS a2 FROM apa JOIN indivs USING (indiv) WINDOW w AS (PARTITION BY snp)")
def residual_alleles(spark, d):
    from ..operators.alleles import of_ancestry

    a = B.genotypes(spark, d).select("snp", "indiv", *[of_ancestry(k).cast("double").alias(f"a{k + 1}") for k in range(2)])
    return kernels.residualised(a, ["a1", "a2"], B.individuals(spark, d).select("indiv", "cov")).select("snp", "indiv", r6("a1"), r6("a2"))


@query("pca_label_places", "SELECT superpop AS pop, median(pheno) AS pc1, median(CAST(cov AS DOUBLE)) AS pc2, count(*) AS n FROM indivs GROUP BY superpop")
def pca_label_places(spark, d):
    return plotdata.pca_labels(B.individuals(spark, d).select(F.col("superpop").alias("pop"), F.col("pheno").alias("pc1"), F.col("cov").cast("double").alias("pc2")))


@query("ancestry_tracks", "SELECT indiv, 0 AS ploidy, start, stop, anc0 AS anc FROM segs WHERE indiv < 10 UNION ALL SELECT indiv, 1, start, stop, anc1 FROM segs WHERE indiv < 10")
def ancestry_tracks(spark, d):
    s = segments.with_starts(segments.encode(B.genotypes(spark, d)).select("indiv", "stop", "anc0", "anc1"))
    return plotdata.ancestry_tracks(s).select("indiv", "ploidy", "start", "stop", "anc")


@query("admixture_bars", "WITH p AS (SELECT indiv, sum(2 - c0 - c1) / (2.0 * count(*)) AS prop1, sum(c0 + c1) / (2.0 * count(*)) AS prop2 FROM geno GROUP BY indiv), r AS (SELECT *, CASE WHEN prop1 >= prop2 THEN 'prop1' ELSE 'prop2' END AS main, greatest(prop1, prop2) AS t FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY main ORDER BY t DESC, indiv) AS place FROM r) SELECT indiv, main, CAST(place AS INT) AS place, 'prop1' AS ancestry, 0.0::DOUBLE AS bottom, round(prop1, 6) AS top FROM o UNION ALL SELECT indiv, main, CAST(place AS INT), 'prop2', round(prop1, 6), round(prop1 + prop2, 6) FROM o")
def admixture_bars(spark, d):
    p = segments.proportions(segments.encode(B.genotypes(spark, d)), 2).select("indiv", "prop1", "prop2")
    return plotdata.admixture_bars(p, ["prop1", "prop2"]).select("indiv", "main", "place", "ancestry", r6("bottom"), r6("top"))


@query("he_moments_covariance")
def he_moments_covariance(spark, d):
    """a, estimate, se of the variances of both kernels and the environment."""
    est, cov = variance.he_covariance(_kernels(spark, d).drop("e"), ["k1", "k2"], people(spark, d), ["one", "cov"])
    return spark.createDataFrame([(k, float(v), float(cov[i, i]) ** 0.5) for i, (k, v) in enumerate(est.items())], "a string, estimate double, se double")


@query("reml_two_kernels")
def reml_two_kernels(spark, d):
    got = variance.reml_components(_kernels(spark, d).drop("e"), ["k1", "k2"], people(spark, d), ["one", "cov"])
    return spark.createDataFrame([(k, float(v)) for k, v in got["var"].items()], "a string, variance double")


@query("sim_from_kernels")
def sim_from_kernels(spark, d):
    return simulate.from_kernels(_kernels(spark, d).drop("e"), {"k1": 0.4, "k2": 0.1, "e": 0.5}, n_sim=3)


@query("sim_binary")
def sim_binary(spark, d):
    return simulate.binary(B.individuals(spark, d).select("indiv", (F.col("pheno") / 3000).alias("pheno")), 0.2, "logit")


@query("sim_case_control")
def sim_case_control(spark, d):
    return simulate.case_control(simulate.binary(B.individuals(spark, d).select("indiv", "pheno"), 0.2), 1.0)


@query("sim_haplotypes")
def sim_haplotypes(spark, d):
    return simulate.haplotype_ancestry(spark, B.variants(spark, d).count(), 2 * B.individuals(spark, d).count(), 50.0, [0.8, 0.2])


@query("sim_frequencies")
def sim_frequencies(spark, d):
    from ..operators.alleles import frequency

    return simulate.balding_nichols(frequency(B.genotypes(spark, d)), 0.1, 2)


@query("loglkl_posterior", "SELECT s_nationkey AS g, s_suppkey AS rg, round(exp(-s_suppkey / 50.0) / sum(exp(-s_suppkey / 50.0)) OVER (PARTITION BY s_nationkey), 8) AS prob FROM supplier")
def loglkl_posterior(spark, d):
    s = B.table(spark, d, "supplier").selectExpr("s_nationkey AS g", "s_suppkey AS rg", "-s_suppkey / 50.0D AS loglkl")
    return stats.curve_probability(s, ["g"]).select("g", "rg", r6("prob", digits=8))
