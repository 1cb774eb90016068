"""Ancestry-specific allele statistics. Everything per (snp, indiv) is a projection of ``geno``."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

def of_ancestry(a: int) -> Column:
    """Alleles a person carries on haplotypes of ancestry ``a``; null if one of those is missing."""
    return F.when(F.col("c0") == a, F.col("a0")).otherwise(0) + F.when(F.col("c1") == a, F.col("a1")).otherwise(0)


def haplotypes_of(a: int) -> Column:
    return (F.col("c0") == a).cast("int") + (F.col("c1") == a).cast("int")


def dosage() -> Column:
    return F.col("a0") + F.col("a1")


def haplotypes(geno: DataFrame) -> DataFrame:
    """One row per haplotype: snp, indiv, ploidy, allele, anc."""
    both = F.array(*[F.struct(F.lit(h).alias("ploidy"), F.col(f"a{h}").alias("allele"), F.col(f"c{h}").alias("anc")) for h in (0, 1)])
    return geno.select("snp", "indiv", F.inline(both))


def allele_per_anc(geno: DataFrame, n_anc: int) -> DataFrame:
    return geno.select("snp", "indiv", *[of_ancestry(a).alias(f"g{a + 1}") for a in range(n_anc)])


def _sums(n_anc: int) -> list[Column]:
    out = []
    for a in range(n_anc):
        out.append(F.sum(of_ancestry(a)).alias(f"_s{a}"))
        out.append(F.sum(haplotypes_of(a)).alias(f"_n{a}"))
        # A missing allele makes its (snp, ancestry) cell missing.
        out.append(F.max(of_ancestry(a).isNull()).alias(f"_m{a}"))
    return out


def af_per_anc(geno: DataFrame, n_anc: int) -> DataFrame:
    """snp, anc, af, n_haplo; af is null where no haplotype has the ancestry or one of them is missing.

    Conditional sums per variant, then an unpivot: one row per variant and task is shuffled.
    """
    wide = geno.groupBy("snp").agg(*_sums(n_anc))
    cells = F.array(*[F.struct(F.lit(a).alias("anc"), F.when(~F.col(f"_m{a}"), F.try_divide(f"_s{a}", f"_n{a}")).alias("af"), F.col(f"_n{a}").alias("n_haplo")) for a in range(n_anc)])
    return wide.select("snp", F.inline(cells))


def frequency(geno: DataFrame) -> DataFrame:
    """snp, freq over the alleles that are present."""
    present = F.col("a0").isNotNull().cast("int") + F.col("a1").isNotNull().cast("int")
    return geno.groupBy("snp").agg(F.try_divide(F.sum(F.coalesce("a0", F.lit(0)) + F.coalesce("a1", F.lit(0))), F.sum(present)).alias("freq"))


def variant_info(geno: DataFrame, n_anc: int) -> DataFrame:
    """snp, lanc_freq1.., lanc_nhaplo1.., freq: one pass."""
    present = F.col("a0").isNotNull().cast("int") + F.col("a1").isNotNull().cast("int")
    alleles = F.coalesce("a0", F.lit(0)) + F.coalesce("a1", F.lit(0))
    wide = geno.groupBy("snp").agg(*_sums(n_anc), F.sum(alleles).alias("_s"), F.sum(present).alias("_n"))
    return wide.select(
        "snp", *[F.when(~F.col(f"_m{a}"), F.try_divide(f"_s{a}", f"_n{a}")).alias(f"lanc_freq{a + 1}") for a in range(n_anc)],
        *[F.col(f"_n{a}").alias(f"lanc_nhaplo{a + 1}") for a in range(n_anc)], F.try_divide("_s", "_n").alias("freq"),
    )


def frequency_within(geno: DataFrame, indivs: DataFrame, group: str, groups: list[str] | None = None) -> DataFrame:
    """snp, group, freq, n_haplo: frequency within each cluster of individuals."""
    clusters = indivs.select("indiv", F.col(group).alias("group"))
    if groups is not None:
        clusters = clusters.where(F.col("group").isin(*groups))
    return geno.join(clusters, "indiv").groupBy("snp", "group").agg(F.try_divide(F.sum(dosage()), 2 * F.count(dosage())).alias("freq"), (2 * F.count(dosage())).alias("n_haplo"))


def impute_mean(dosages: DataFrame, value: str = "g", axis: str = "snp", most: int = 2_000_000) -> DataFrame:
    """Missing values become the mean of their variant (or of their individual). Up to ``most`` means go to
    the tasks whole, so that dosages aren't shuffled."""
    means = written(dosages.groupBy(axis).agg(F.avg(value).alias("_mean")))
    means = F.broadcast(means) if means.count() <= most else means
    return dosages.join(means, axis).withColumn(value, F.coalesce(F.col(value).cast("double"), F.col("_mean"))).drop("_mean")


def multiply(geno: DataFrame, weights: DataFrame, by: str = "snp") -> DataFrame:
    """Mean-imputed dosage times a matrix in long form.

    by='snp': weights (snp, col, w) -> (indiv, col, value); by='indiv': weights (indiv, col, w) -> (snp, col, value).
    """
    g = impute_mean(geno.select("snp", "indiv", dosage().alias("g")))
    keep = "indiv" if by == "snp" else "snp"
    return g.join(weights, by).groupBy(keep, "col").agg(F.sum(F.col("g") * F.col("w")).alias("value"))


def variant_moments(geno: DataFrame) -> DataFrame:
    """snp, mean, std (population) of the dosage."""
    return geno.groupBy("snp").agg(F.avg(dosage()).alias("mean"), F.stddev_pop(dosage()).alias("std"))


def prior_variance(freqs: DataFrame, model: str, freq: str = "freq", weight: str = "weight") -> DataFrame:
    """Add ``prior_var`` under a heritability model: uniform, gcta, mafukb or ldak."""
    het = F.col(freq) * (1 - F.col(freq))
    powers = {"uniform": 0.0, "gcta": -1.0, "mafukb": -0.38, "ldak": -0.25}
    if model not in powers:
        raise ValueError(f"model is one of {sorted(powers)}")
    if model == "uniform":
        return freqs.withColumn("prior_var", F.lit(1.0))
    value = F.pow(F.when(het > 0, het), F.lit(powers[model]))
    return freqs.withColumn("prior_var", value * F.col(weight) if model == "ldak" else value)


def hsq_scale(weights: DataFrame, freqs: DataFrame) -> DataFrame:
    """scale = sum of normalised prior variance times 2 f (1 - f); every weighted variant needs a frequency."""
    j = weights.join(freqs, "snp", "left")
    return j.agg(F.try_divide(F.sum(F.col("prior_var") * 2 * F.col("freq") * (1 - F.col("freq"))), F.sum("prior_var")).alias("scale"), F.sum(F.col("freq").isNull().cast("long")).alias("n_uncovered"))


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)
