"""Queries of relationship and linkage matrices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import kernels as K
from ..operators import linkage as L
from ..operators.frames import checkpoint_folder, written
from ..sources import bridge as B
from .base import query, r6

_Z = "z AS (SELECT snp, indiv, {z} AS z FROM (SELECT snp, indiv, g - avg(g) OVER w AS c, stddev_pop(g) OVER w AS sd FROM apa WINDOW w AS (PARTITION BY snp)))"
_GRM = "WITH {z} SELECT a.indiv AS i, b.indiv AS j, round(sum(a.z * b.z) / (SELECT count(*) FROM snps), 6) AS value FROM z a JOIN z b ON a.snp = b.snp AND a.indiv >= b.indiv GROUP BY ALL"


@query("grm_std", _GRM.format(z=_Z.format(z="CASE WHEN sd > 0 THEN c / sd ELSE 0 END")))
def grm_std(spark, d):
    return K.grm(B.genotypes(spark, d)).select("i", "j", r6("value"))


@query("grm_allele", _GRM.format(z=_Z.format(z="c")))
def grm_allele(spark, d):
    return K.grm(B.genotypes(spark, d), "allele").select("i", "j", r6("value"))


@query("grm_subpop", _GRM.format(z="z AS (SELECT snp, indiv, g - avg(g) OVER (PARTITION BY snp, superpop) AS z FROM apa JOIN indivs USING (indiv))"))
def grm_subpop(spark, d):
    groups = B.individuals(spark, d).select("indiv", F.col("superpop").alias("group"))
    return K.grm(B.genotypes(spark, d), "allele", groups).select("i", "j", r6("value"))


_PAIRS = "pairs AS (SELECT a.indiv AS i, b.indiv AS j, sum(a.g1 * b.g1 * weight) / w AS g1, sum(a.g2 * b.g2 * weight) / w AS g2, sum(a.g1 * b.g2 * weight) / w AS g12, sum(a.g2 * b.g1 * weight) / w AS g21 FROM apa a JOIN apa b ON a.snp = b.snp AND a.indiv >= b.indiv JOIN snps ON snps.snp = a.snp, (SELECT sum(weight) AS w FROM snps) GROUP BY a.indiv, b.indiv, w)"


def _prior(spark, d):
    return B.variants(spark, d).select("snp", F.col("weight").alias("prior_var"))


@query("admix_grm_raw", f"WITH {_PAIRS} SELECT i, j, round(g1, 6) AS g1, round(g2, 6) AS g2, round(g12, 6) AS g12, round(g21, 6) AS g21 FROM pairs")
def admix_grm_raw(spark, d):
    return K.admix_grm_raw(B.genotypes(spark, d), _prior(spark, d)).select("i", "j", r6("g1"), r6("g2"), r6("g12"), r6("g21"))


@query("admix_grm", f"WITH {_PAIRS} SELECT i, j, round(g1 + g2, 6) AS k1, round(g12 + g21, 6) AS k2 FROM pairs")
def admix_grm(spark, d):
    return K.admix_grm(B.genotypes(spark, d), 2, _prior(spark, d)).select("i", "j", r6("k1"), r6("k2"))


@query("admix_grm_merge", f"WITH {_PAIRS} SELECT i, j, round(g1 + g2, 6) AS k1, round(g12 + g21, 6) AS k2 FROM pairs")
def admix_grm_merge(spark, d):
    """Kernels of two halves of the variants, merged by their prior variance: equal to the kernel of all."""
    p, g = _prior(spark, d), B.genotypes(spark, d)
    parts = None
    for half in (0, 1):
        mine = p.where(F.pmod("snp", F.lit(2)) == half)
        k = K.admix_grm(g, 2, mine).crossJoin(mine.agg(F.sum("prior_var").alias("w")))
        parts = k if parts is None else parts.unionByName(k)
    return K.merge_kernels(parts, ["k1", "k2"]).select("i", "j", r6("k1"), r6("k2"))


@query("kernel_growing", f"WITH {_PAIRS} SELECT i, j, round(g1 + g2, 6) AS k1, round(g12 + g21, 6) AS k2 FROM pairs")
def kernel_growing(spark, d):
    """The kernel of people who come in three batches, the second of them twice: equal to that of all at once."""
    from ..streaming.incremental import grow, grown_kernel

    out = f"{checkpoint_folder(spark)}/growing-{uuid.uuid4().hex}"
    g, prior = B.genotypes(spark, d), _prior(spark, d)
    for number, third in enumerate((2, 0, 0, 1)):
        grow(g.where(F.pmod("indiv", F.lit(3)) == third), out, min(number, 1) if number < 3 else 2, 2, prior)
    return grown_kernel(spark, out, 2, prior).select("i", "j", r6("k1"), r6("k2"))


_LD = """c AS (SELECT chrom, snp, indiv, g1 - avg(g1) OVER (PARTITION BY snp) AS g1, g2 - avg(g2) OVER (PARTITION BY snp) AS g2 FROM apa JOIN snps USING (snp)),
ld AS (SELECT a.chrom, a.snp AS s, b.snp AS t, avg(a.g1 * b.g1) AS ld11, avg(a.g2 * b.g2) AS ld22, avg(a.g1 * b.g2) AS ld12, avg(a.g2 * b.g1) AS ld21 FROM c a JOIN c b ON a.chrom = b.chrom AND a.indiv = b.indiv AND a.snp >= b.snp GROUP BY ALL)"""


@query("admix_ld", f"WITH {_LD} SELECT chrom, s, t, round(ld11, 6) AS ld11, round(ld22, 6) AS ld22, round(ld12, 6) AS ld12, round(ld21, 6) AS ld21 FROM ld")
def admix_ld(spark, d):
    return K.ancestry_ld(B.genotypes(spark, d), B.variants(spark, d)).select("chrom", "s", "t", *map(r6, ("ld11", "ld22", "ld12", "ld21")))


@query(
    "admix_tagging",
    f"""WITH {_LD}, d AS (SELECT chrom, s AS tag, ld11 AS a, ld12 AS b, ld22 AS c, CASE WHEN abs(ld11 * ld22 - ld12 * ld12) > 1e-12 THEN ld11 * ld22 - ld12 * ld12 END AS det FROM ld WHERE s = t),
       p AS (SELECT chrom, s AS tag, t AS causal, ld11 + ld12 AS r1, ld21 + ld22 AS r2 FROM ld UNION ALL SELECT chrom, t, s, ld11 + ld21, ld12 + ld22 FROM ld WHERE s <> t)
       SELECT chrom, tag, causal, round((c * r1 - b * r2) / det, 9) AS beta1, round((a * r2 - b * r1) / det, 9) AS beta2 FROM p JOIN d USING (chrom, tag)""",
)
def admix_tagging(spark, d):
    ld = K.ancestry_ld(B.genotypes(spark, d), B.variants(spark, d))
    return K.tagging(ld).select("chrom", "tag", "causal", r6("beta1", digits=9), r6("beta2", digits=9))


_CORR = "r AS (SELECT a.chrom, a.snp AS s, b.snp AS t, corr(a.g, b.g) AS corr FROM (SELECT * FROM apa JOIN snps USING (snp)) a JOIN (SELECT * FROM apa JOIN snps USING (snp)) b ON a.chrom = b.chrom AND a.indiv = b.indiv AND a.snp > b.snp GROUP BY ALL HAVING var_pop(a.g) > 0 AND var_pop(b.g) > 0)"


@query("snp_corr", f"WITH {_CORR} SELECT chrom, s, t, round(corr, 6) AS corr FROM r")
def snp_corr(spark, d):
    return K.correlations(B.genotypes(spark, d), B.variants(spark, d)).select("chrom", "s", "t", r6("corr"))


@query("ld_r2_window", f"WITH {_CORR} SELECT chrom, s, t, round(corr * corr, 6) AS r2 FROM r WHERE s - t < 20 AND corr * corr > 0.1")
def ld_r2_window(spark, d):
    r2 = K.correlations(B.genotypes(spark, d), B.variants(spark, d), 20).withColumn("r2", F.col("corr") * F.col("corr"))
    return r2.where("s - t < 20 AND r2 > 0.1").select("chrom", "s", "t", r6("r2"))


@query(
    "ld_prune",
    f"""WITH RECURSIVE {_CORR}, nb AS MATERIALIZED (SELECT s AS snp, list(t) AS earlier FROM r WHERE s - t < 100 AND corr * corr > 0.1 GROUP BY s),
       line AS MATERIALIZED (SELECT chrom, snp, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY chrom ORDER BY snp) AS k FROM snps LEFT JOIN nb USING (snp)),
       walk AS (SELECT chrom, k, [snp] AS kept FROM line WHERE k = 1 UNION ALL SELECT o.chrom, o.k, CASE WHEN list_has_any(w.kept, o.earlier) THEN w.kept ELSE list_append(w.kept, o.snp) END FROM walk w JOIN line o ON o.chrom = w.chrom AND o.k = w.k + 1)
       SELECT snp, chrom, pos FROM snps WHERE snp IN (SELECT unnest(kept) FROM (SELECT chrom, arg_max(kept, k) AS kept FROM walk GROUP BY chrom))""",
)
def ld_prune(spark, d):
    r2 = K.correlations(B.genotypes(spark, d), B.variants(spark, d), 100).withColumn("r2", F.col("corr") * F.col("corr"))
    return L.prune(r2, B.variants(spark, d)).select("snp", "chrom", "pos")


def _association(spark, d):
    return A.linear(B.genotypes(spark, d), B.individuals(spark, d), "pheno", 2, "ASE").join(B.variants(spark, d), "snp").select("snp", "chrom", "pos", F.col("P").alias("p"))


_P = """mo AS (SELECT snp, count(*) AS n, covar_pop(g1, g1) AS a, covar_pop(g1, g2) AS b, covar_pop(g2, g2) AS c, covar_pop(g1, pheno) AS u, covar_pop(g2, pheno) AS v, var_pop(pheno) AS yy FROM apa JOIN indivs USING (indiv) GROUP BY snp),
rs AS (SELECT *, yy - (c * u * u - 2 * b * u * v + a * v * v) / CASE WHEN a * c - b * b > 1e-12 THEN a * c - b * b END AS r FROM mo),
st AS (SELECT snp, chrom, pos, pow(1 + ((yy - r) / r), -(n - 3) / 2.0) AS p FROM rs JOIN snps USING (snp) WHERE n > 3)"""


_LINKED = f"{_CORR}, {_P}, both_ AS (SELECT chrom, s AS i, t AS k, corr * corr AS r2 FROM r UNION ALL SELECT chrom, t, s, corr * corr FROM r), linked AS (SELECT x.chrom, x.i AS index, x.k AS snp, r2 FROM both_ x JOIN st a ON a.snp = x.i JOIN st b ON b.snp = x.k WHERE r2 > 0.1 AND a.p <= 0.05 AND b.p <= 0.2 AND abs(a.pos - b.pos) <= 3000000)"


def _clump_candidates(spark, d):
    s = written(_association(spark, d))
    return s, L.clump_candidates(s, L.clump_links(B.genotypes(spark, d), s, 0.05, 0.2, 3000), 0.05, 0.2, 0.1, 3000)


@query("clump_pairs", f"WITH {_LINKED} SELECT chrom, index, snp, round(r2, 6) AS r2 FROM linked")
def clump_pairs(spark, d):
    return _clump_candidates(spark, d)[1].select("chrom", "index", "snp", r6("r2"))


@query(
    "clump",
    f"""WITH RECURSIVE {_LINKED}, cand AS MATERIALIZED (SELECT index, list(snp ORDER BY snp) AS cand FROM linked GROUP BY index),
       line AS MATERIALIZED (SELECT chrom, st.snp AS index, coalesce(cand, []) AS cand, row_number() OVER (PARTITION BY chrom ORDER BY p, st.snp) AS k FROM st LEFT JOIN cand ON cand.index = st.snp WHERE p <= 0.05),
       walk AS (SELECT chrom, k, index, cand AS mine, list_append(cand, index) AS used, true AS stays FROM line WHERE k = 1
           UNION ALL SELECT chrom, k, index, mine, CASE WHEN stays THEN list_append(list_concat(used, mine), index) ELSE used END, stays
           FROM (SELECT o.chrom, o.k, o.index, [x FOR x IN o.cand IF NOT list_contains(w.used, x)] AS mine, w.used, NOT list_contains(w.used, o.index) AS stays FROM walk w JOIN line o ON o.chrom = w.chrom AND o.k = w.k + 1))
       SELECT chrom, index, array_to_string(mine, ',') AS members FROM walk WHERE stays""",
)
def clump(spark, d):
    return L.clump(*_clump_candidates(spark, d), 0.05).select("chrom", "index", F.array_join("members", ",").alias("members"))


@query("pca")
def pca(spark, d):
    return K.principal_components(K.grm(B.genotypes(spark, d)), 4)
