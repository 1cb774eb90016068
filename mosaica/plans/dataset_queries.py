"""Queries of sources, filters, joins and dataset maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import align as L
from ..operators import dataset as D
from ..operators import segments as S
from ..sources import bridge as B
from .base import query, r6
from .segment_queries import segments


@query("scan_snp_info_join", "SELECT snp, chrom, pos, ref, alt, size, brand FROM snps")
def scan_snp_info_join(spark, d):
    from ..sources.text import attach_info

    core = B.variants(spark, d).select("snp", "chrom", "pos", "ref", "alt")
    return attach_info(core, B.variants(spark, d).select("snp", "size", "brand"), "snp")


@query("digit_mat_parse", "WITH l AS (SELECT c_custkey AS row, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer) SELECT row, CAST(i - 1 AS INT) AS col, CAST(substr(digits, i, 1) AS TINYINT) AS value FROM (SELECT *, unnest(range(1, length(digits) + 1)) AS i FROM l)")
def digit_mat_parse(spark, d):
    from ..sources.text import parse_digits

    lines = B.table(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.col("c_name").alias("value"))
    return parse_digits(lines, filter_non_numeric=True)


def regions(spark, d):
    """Ancestry regions per chromosome as a local-ancestry caller writes them: 10 variants wide, one column per haplotype."""
    v = B.variants(spark, d).groupBy("chrom", F.expr("snp DIV 10").alias("region")).agg(F.min("pos").alias("spos"), F.max("pos").alias("last"))
    return v.select("chrom", "region", "spos", (F.col("last") + 1).alias("epos"))


_REGIONS = "regions AS (SELECT chrom, snp // 10 AS region, min(pos) AS spos, max(pos) + 1 AS epos FROM snps GROUP BY ALL), calls AS (SELECT region, chrom, spos, epos, indiv, CAST((region + indiv) % 2 AS INT) AS anc0, CAST((region * 3 + indiv) % 2 AS INT) AS anc1 FROM regions, indivs)"


@query("rfmix_range_join", f"WITH {_REGIONS} SELECT s.snp, c.indiv, c.anc0 AS c0, c.anc1 AS c1 FROM snps s JOIN calls c ON s.chrom = c.chrom AND s.pos >= c.spos AND s.pos < c.epos")
def rfmix_range_join(spark, d):
    from ..sources.rfmix import regions_to_variants

    calls = regions(spark, d).crossJoin(B.individuals(spark, d).select("indiv")).selectExpr("chrom", "spos", "epos", "indiv", "CAST((region + indiv) % 2 AS INT) AS anc0", "CAST((region * 3 + indiv) % 2 AS INT) AS anc1")
    return regions_to_variants(B.variants(spark, d).select("snp", "chrom", "pos"), calls, stretch=False)


@query("joint_pca_label", "SELECT e.vec_id AS indiv, round(CAST(e.embedding[1] AS DOUBLE), 6) AS pc1, coalesce(i.pop, 'SAMPLE') AS pop, i.pop IS NULL AS is_sample FROM embeddings e LEFT JOIN indivs i ON i.indiv = e.vec_id")
def joint_pca_label(spark, d):
    from ..operators.select import label_populations

    pcs = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("indiv"), F.col("embedding")[0].cast("double").alias("pc1"))
    out = label_populations(pcs, B.individuals(spark, d).select("indiv", "pop"))
    return out.select("indiv", r6("pc1"), "pop", "is_sample")


@query("subset_snp_indiv", "SELECT snp - 20 AS snp, indiv - 2 AS indiv, a0, a1, c0, c1 FROM geno WHERE snp BETWEEN 20 AND 119 AND indiv BETWEEN 2 AND 8")
def subset_snp_indiv(spark, d):
    p = B.panel(spark, d).slice(20, 120, 2, 9)
    return p.geno.select((F.col("snp") - 20).alias("snp"), (F.col("indiv") - 2).alias("indiv"), "a0", "a1", "c0", "c1")


@query("subset_ids_semi", "SELECT g.snp, g.indiv, a0 + a1 AS g FROM geno g WHERE snp IN (SELECT snp FROM snps WHERE size > 40) AND indiv IN (SELECT indiv FROM indivs WHERE affected = 1)")
def subset_ids_semi(spark, d):
    p = B.panel(spark, d).where_snps("size > 40").where_indivs("affected = 1")
    return p.geno.select("snp", "indiv", (F.col("a0") + F.col("a1")).alias("g"))


@query("snp_list_filter", "SELECT snp, chrom, pos, true AS found FROM snps WHERE snp IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ")
def snp_list_filter(spark, d):
    ids = B.table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey")
    kept, _ = D.listed(B.variants(spark, d), ids, "snp")
    return kept.select("snp", "chrom", "pos", F.lit(True).alias("found"))


@query("pheno_filter", "WITH p AS (SELECT indiv, CASE WHEN indiv % 7 = 3 THEN NULL ELSE pheno END AS pheno, CASE WHEN indiv % 5 = 1 THEN NULL ELSE cov END AS c1, CASE WHEN indiv % 3 = 1 THEN NULL ELSE superpop END AS c2 FROM indivs) SELECT * FROM p WHERE pheno IS NOT NULL AND (c1 IS NOT NULL OR c2 IS NOT NULL)")
def pheno_filter(spark, d):
    p = B.individuals(spark, d).selectExpr("indiv", "IF(indiv % 7 = 3, NULL, pheno) AS pheno", "IF(indiv % 5 = 1, NULL, cov) AS c1", "IF(indiv % 3 = 1, NULL, superpop) AS c2")
    return D.with_phenotype(p, "pheno", ["c1", "c2"])


@query("pop_subset", "SELECT indiv, name, pop, superpop FROM indivs WHERE superpop IN ('AFRICA', 'EUROPE') AND pop <> 'NATION_0'")
def pop_subset(spark, d):
    return D.of_population(B.individuals(spark, d), superpop=["AFRICA", "EUROPE"], exclude_pop="NATION_0").select("indiv", "name", "pop", "superpop")


@query("append_info_check", "SELECT col AS \"column\", CAST(n AS BIGINT) AS n_differ FROM (SELECT 'pheno' AS col, count(*) FILTER (indiv % 10 = 0) AS n FROM indivs UNION ALL SELECT 'superpop', 0)")
def append_info_check(spark, d):
    a = B.individuals(spark, d)
    b = a.select("indiv", F.when(F.col("indiv") % 10 == 0, F.col("pheno") + 1).otherwise(F.col("pheno") * (1 + 1e-9)).alias("pheno"), "superpop")
    return D.same_values(a, b, "indiv", ["pheno", "superpop"])


@query("align_check", "SELECT snp, chrom, pos, ref, alt, 'left' AS side FROM snps WHERE size = 7 UNION ALL SELECT snp, chrom, pos + 1, ref, alt, 'right' FROM snps WHERE size = 7")
def align_check(spark, d):
    cols = ["snp", "chrom", "pos", "ref", "alt"]
    a = B.variants(spark, d)
    return D.differences(a, a.withColumn("pos", F.col("pos") + (F.col("size") == 7).cast("int")), cols)


@query("convert_dummy", "SELECT indiv, pheno, CAST(superpop = 'AMERICA' AS INT) AS superpop_AMERICA, CAST(superpop = 'ASIA' AS INT) AS superpop_ASIA, CAST(superpop = 'EUROPE' AS INT) AS superpop_EUROPE, CAST(superpop = 'MIDDLE EAST' AS INT) AS \"superpop_MIDDLE EAST\" FROM indivs")
def convert_dummy(spark, d):
    levels = [r[0] for r in B.table(spark, d, "region").select("r_name").orderBy("r_name").collect()]
    return D.dummies(B.individuals(spark, d).select("indiv", "pheno", "superpop"), "superpop", levels)


@query("ld_block_split", "WITH b AS (SELECT chrom, CAST(floor(min(pos)) AS BIGINT) + k * 13000 AS start, min(pos) + k * 13000 + 13000 AS stop, k FROM snps, (SELECT unnest([0, 1, 2]) AS k) GROUP BY chrom, k) SELECT s.snp, s.chrom, s.pos, b.k AS block FROM snps s JOIN b ON s.chrom = b.chrom AND s.pos >= b.start AND s.pos < b.stop")
def ld_block_split(spark, d):
    v = B.variants(spark, d).select("snp", "chrom", "pos")
    b = v.groupBy("chrom").agg(F.min("pos").alias("_m")).select("chrom", "_m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("block"))
    b = b.select("chrom", (F.col("_m") + F.col("block") * 13000).alias("start"), (F.col("_m") + F.col("block") * 13000 + 13000).alias("stop"), "block")
    return D.ld_blocks(v, b, width=13000).select("snp", "chrom", "pos", "block")


@query("panel_summary", "SELECT (SELECT count(*) FROM snps) AS n_snp, (SELECT count(*) FROM indivs) AS n_indiv, 2 * (SELECT count(*) FROM indivs) AS n_haplotype, 2 AS n_anc")
def panel_summary(spark, d):
    return B.panel(spark, d).summary()


@query("unrelated_anti", "SELECT pop, count(*) AS n FROM indivs WHERE indiv NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08) GROUP BY pop")
def unrelated_anti(spark, d):
    related = B.table(spark, d, "lineitem").where("l_quantity = 50 AND l_discount > 0.08").select(F.col("l_suppkey").alias("indiv"))
    return D.unrelated(B.individuals(spark, d), related).groupBy("pop").agg(F.count("*").alias("n"))


@query("dedup_position", "SELECT snp, chrom, pos FROM (SELECT snp, chrom, pos, row_number() OVER (PARTITION BY chrom, pos ORDER BY snp) AS k FROM (SELECT snp, chrom, size AS pos FROM snps)) WHERE k = 1")
def dedup_position(spark, d):
    return D.first_at_position(B.variants(spark, d).select("snp", "chrom", F.col("size").alias("pos")))


@query("sorted_check", "SELECT chrom, count(*) AS n, CAST(sum(CAST(coalesce(lagged > size, false) AS INT)) AS BIGINT) AS n_unsorted FROM (SELECT *, lag(size) OVER (PARTITION BY chrom ORDER BY snp) AS lagged FROM snps) GROUP BY chrom")
def sorted_check(spark, d):
    return D.sorted_breaks(B.variants(spark, d).select("snp", "chrom", F.col("size").alias("pos")))


@query("qc_filter", "WITH c AS (SELECT snp, sum(g) AS ac, 2 * count(*) AS an FROM apa GROUP BY snp) SELECT snp, chrom, pos, ref, alt, CAST(ac AS BIGINT) AS ac, an FROM snps JOIN c USING (snp) WHERE least(ac, an - ac) >= 5")
def qc_filter(spark, d):
    g = B.genotypes(spark, d)
    counts = g.groupBy("snp").agg(F.sum(F.col("a0") + F.col("a1")).alias("ac"), (2 * F.count("*")).alias("an"))
    return D.quality_control(B.variants(spark, d), counts).select("snp", "chrom", "pos", "ref", "alt", "ac", "an")


@query("variant_id", "SELECT snp, chrom || ':' || pos || ':' || ref || ':' || alt AS id FROM snps")
def variant_id(spark, d):
    return B.variants(spark, d).select("snp", D.variant_id().alias("id"))


@query("str2int", "SELECT c_custkey AS id, CAST('0x' || right(sha256(c_name), 8) AS BIGINT) AS seed FROM customer")
def str2int(spark, d):
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), D.seed_of(F.col("c_name")).alias("seed"))


@query("common_ids", "SELECT p_partkey AS id FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def common_ids(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id")).intersect(B.table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id")))


@query("missing_ids", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def missing_ids(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id")).join(B.table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id")), "id", "left_anti")


_OTHER = "other AS (SELECT snp + 1000000 AS snp, chrom, pos, CASE WHEN snp % 3 = 0 THEN alt WHEN snp % 11 = 5 THEN 'N' ELSE ref END AS ref, CASE WHEN snp % 3 = 0 THEN ref ELSE alt END AS alt, weight FROM snps WHERE size > 5), pairs AS (SELECT a.chrom, a.pos, a.snp AS snp1, b.snp AS snp2, CASE WHEN a.ref = b.ref AND a.alt = b.alt THEN 1 ELSE -1 END AS flip, b.weight FROM snps a JOIN other b ON a.chrom = b.chrom AND a.pos = b.pos AND ((a.ref = b.ref AND a.alt = b.alt) OR (a.ref = b.alt AND a.alt = b.ref)))"


def _other(spark, d):
    """A second variant table: some positions missing, a third of the alleles swapped, some not matching."""
    return B.variants(spark, d).where("size > 5").selectExpr("snp + 1000000 AS snp", "chrom", "pos", "CASE WHEN snp % 3 = 0 THEN alt WHEN snp % 11 = 5 THEN 'N' ELSE ref END AS ref", "IF(snp % 3 = 0, ref, alt) AS alt", "weight")


@query("align_snp", f"WITH {_OTHER} SELECT chrom, pos, snp1, snp2, flip FROM pairs")
def align_snp(spark, d):
    return L.align_snp(B.variants(spark, d), _other(spark, d))


@query("prs_match", f"WITH {_OTHER} SELECT snp1 AS snp, flip, round(weight * flip, 6) AS weight FROM pairs")
def prs_match(spark, d):
    return L.match_weights(B.variants(spark, d), _other(spark, d).select("chrom", "pos", "ref", "alt", "weight"), ["weight"]).select("snp", "flip", r6("weight"))


def _other_geno(spark, d):
    return B.genotypes(spark, d).selectExpr("snp + 1000000 AS snp", "indiv + 1000000 AS indiv", "a0", "a1", "c0", "c1")


@query("align_flip_geno", f"WITH {_OTHER} SELECT snp1 AS snp, indiv + 1000000 AS indiv, CASE WHEN flip = -1 THEN 1 - a0 ELSE a0 END AS a0, CASE WHEN flip = -1 THEN 1 - a1 ELSE a1 END AS a1, c0, c1 FROM pairs JOIN geno ON geno.snp = snp1")
def align_flip_geno(spark, d):
    return L.align_genotypes(B.variants(spark, d), _other(spark, d), _other_geno(spark, d))


@query("merge_indiv", f"WITH {_OTHER} SELECT snp1 AS snp, indiv, a0, a1, c0, c1 FROM pairs JOIN geno ON geno.snp = snp1 UNION ALL SELECT snp1, indiv + 1000000, CASE WHEN flip = -1 THEN 1 - a0 ELSE a0 END, CASE WHEN flip = -1 THEN 1 - a1 ELSE a1 END, c0, c1 FROM pairs JOIN geno ON geno.snp = snp1")
def merge_indiv(spark, d):
    return L.merge_individuals(B.variants(spark, d), B.genotypes(spark, d), _other(spark, d), _other_geno(spark, d))


@query("hm3_semi", "SELECT snp, chrom, pos FROM snps WHERE brand IN ('Brand#2', 'Brand#17', 'Brand#5')")
def hm3_semi(spark, d):
    v = B.variants(spark, d)
    return L.in_reference(v, v.where("brand IN ('Brand#2', 'Brand#17', 'Brand#5')")).select("snp", "chrom", "pos")


_CHAIN = "chain AS (SELECT chrom, min(pos) + k * 9000 AS start, min(pos) + k * 9000 + 9000 + 2000 * (k % 2) AS stop, chrom + 100 AS to_chrom, 5000000 + k * 20000 AS to_start, k % 3 <> 1 AS forward FROM snps, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY chrom, k)"


_LIFTED = f"WITH {_CHAIN}, hit AS (SELECT s.snp, count(*) AS n, any_value(to_chrom) AS c, any_value(CASE WHEN forward THEN to_start + pos - start ELSE to_start + stop - 1 - pos END) AS p FROM snps s JOIN chain b ON s.chrom = b.chrom AND pos >= start AND pos < stop GROUP BY s.snp) SELECT snp, CASE WHEN n = 1 THEN c ELSE -1 END AS chrom, CASE WHEN n = 1 THEN p ELSE -1 END AS pos FROM snps LEFT JOIN hit USING (snp)"


def _chain(spark, d):
    v = B.variants(spark, d).select("chrom", "pos")
    c = v.groupBy("chrom").agg(F.min("pos").alias("_m")).select("chrom", "_m", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return c.selectExpr("chrom", "_m + k * 9000 AS start", "_m + k * 9000 + 9000 + 2000 * (k % 2) AS stop", "chrom + 100 AS to_chrom", "CAST(5000000 + k * 20000 AS BIGINT) AS to_start", "k % 3 <> 1 AS forward")


@query("liftover_map", _LIFTED)
def liftover_map(spark, d):
    return L.lift_over(B.variants(spark, d).select("snp", "chrom", "pos"), _chain(spark, d), width=9000)


@query("liftover_table_function", _LIFTED)
def liftover_table_function(spark, d):
    return tables.lift_over(spark, B.variants(spark, d), _chain(spark, d), width=9000)


@query("decode_table_function", "SELECT unnest(range(start, stop)) AS snp, indiv, anc0 AS c0, anc1 AS c1 FROM segs")
def decode_table_function(spark, d):
    return tables.decode(spark, segments(spark, d))


_MAP = "gmap AS (SELECT chrom, pos AS position, sum(size) OVER (PARTITION BY chrom ORDER BY pos) / 100.0 AS cm FROM snps WHERE size > 25)"


def genetic_map(spark, d):
    from pyspark.sql import Window

    v = B.variants(spark, d).where("size > 25")
    return v.select("chrom", F.col("pos").alias("position"), (F.sum("size").over(Window.partitionBy("chrom").orderBy("pos")) / 100.0).cast("double").alias("cm"))


@query(
    "genetic_interp",
    f"""WITH {_MAP}, k AS (SELECT chrom, position AS p0, cm AS c0, lead(position) OVER w AS p1, lead(cm) OVER w AS c1, row_number() OVER w AS i, count(*) OVER (PARTITION BY chrom) AS n FROM gmap WINDOW w AS (PARTITION BY chrom ORDER BY position)),
       g AS (SELECT * FROM k WHERE p1 IS NOT NULL)
       SELECT s.snp, s.chrom, s.pos, round(c0 + (s.pos - p0) * (c1 - c0) / (p1 - p0), 6) AS cm FROM snps s JOIN g ON s.chrom = g.chrom AND (s.pos >= p0 OR i = 1) AND (s.pos < p1 OR i = n - 1)""",
)
def genetic_interp(spark, d):
    return L.interpolate_genetic(B.variants(spark, d).select("snp", "chrom", "pos"), genetic_map(spark, d)).select("snp", "chrom", "pos", r6("cm"))


@query(
    "mosaic_size",
    f"""WITH {_MAP}, reach AS (SELECT chrom, count(*) AS n_snp, min(pos) AS lo, max(pos) AS hi FROM snps GROUP BY chrom)
       SELECT e.chrom, round(n_snp / (8 * ((arg_min(cm, struct_pack(d := abs(position - hi), p := position)) - arg_min(cm, struct_pack(d := abs(position - lo), p := position))) / 100)), 6) AS mosaic_size FROM reach e JOIN gmap USING (chrom) GROUP BY e.chrom, n_snp, lo, hi""",
)
def mosaic_size(spark, d):
    from ..operators.simulate import mosaic_size as size

    return size(B.variants(spark, d), genetic_map(spark, d), n_gen=8).select("chrom", r6("mosaic_size"))
