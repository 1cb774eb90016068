"""A deterministic panel from the star-schema tables: parts are variants, suppliers individuals.

Both tables are used whole. One row per (variant, individual) carries both
haplotypes, so everything that pairs a person's two haplotypes is a projection
and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import Panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geno(snp, indiv, a0, a1, c0, c1): alleles and ancestries of both haplotypes."""
    snps = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp"))
    indivs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("indiv"))
    # Variants are dealt out first: their table is one small file, which would make the whole panel one task.
    parts = 2 * spark.sparkContext.defaultParallelism
    pairs = snps.repartitionByRange(parts, "snp").crossJoin(indivs)
    anc = "(snp DIV (11 + indiv % 13) + indiv + {h} * (indiv % 5)) % 2"
    pairs = pairs.selectExpr("snp", "indiv", *[f"CAST({anc.format(h=h)} AS INT) AS c{h}" for h in (0, 1)])
    allele = "CAST(IF((snp * 7919 + indiv * 104729 + {h} * 1299709 + (snp * indiv) % 101) % 97 < 10 + (snp * 37) % 60 + 15 * c{h}, 1, 0) AS INT)"
    return pairs.selectExpr("snp", "indiv", *[f"{allele.format(h=h)} AS a{h}" for h in (0, 1)], "c0", "c1")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS snp", "CAST(p_partkey DIV 40 AS INT) AS chrom", "p_partkey * 1000 + p_size AS pos",
        "substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref", "substr('CGTA', CAST(1 + p_partkey % 4 AS INT), 1) AS alt",
        "p_retailprice / 1000 AS weight", "p_size AS size", "p_brand AS brand",
    )


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.selectExpr("s_suppkey AS indiv", "s_name AS name", "s_acctbal AS pheno", "CAST(s_acctbal > 4500 AS INT) AS affected", "s_nationkey AS cov", "n_name AS pop", "r_name AS superpop")


def panel(spark: SparkSession, sf_dir: str) -> Panel:
    return Panel(genotypes(spark, sf_dir), variants(spark, sf_dir), individuals(spark, sf_dir), 2)
