"""Alignment of variants between panels, with allele flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import first_at_position


def align_snp(left: DataFrame, right: DataFrame) -> DataFrame:
    """snp1, snp2, flip: variants of both tables with equal position and the same two alleles; flip is -1 where they are swapped."""
    a = left.select("chrom", "pos", F.col("snp").alias("snp1"), F.col("ref").alias("_r1"), F.col("alt").alias("_a1"))
    b = right.select("chrom", "pos", F.col("snp").alias("snp2"), F.col("ref").alias("_r2"), F.col("alt").alias("_a2"))
    same = (F.col("_r1") == F.col("_r2")) & (F.col("_a1") == F.col("_a2"))
    swap = (F.col("_r1") == F.col("_a2")) & (F.col("_a1") == F.col("_r2"))
    return a.join(b, ["chrom", "pos"]).where(same | swap).select("chrom", "pos", "snp1", "snp2", F.when(same, 1).otherwise(-1).alias("flip"))


def match_weights(snps: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """snp and each weight column, negated where the alleles are swapped."""
    found = align_snp(snps, weights.withColumn("snp", F.struct("chrom", "pos", "ref", "alt")))
    values = weights.select(F.struct("chrom", "pos", "ref", "alt").alias("snp2"), *columns)
    return found.join(values, "snp2").select(F.col("snp1").alias("snp"), "flip", *[(F.col(c) * F.col("flip")).alias(c) for c in columns])


def flipped(allele: Column, flip: Column) -> Column:
    return F.when(flip == -1, 1 - allele).otherwise(allele)


def align_genotypes(left_snps: DataFrame, right_snps: DataFrame, right_geno: DataFrame) -> DataFrame:
    """The right panel's genotypes by the left panel's variants and reference alleles; first variant of a position only."""
    pairs = align_snp(first_at_position(left_snps), first_at_position(right_snps))
    g = right_geno.join(pairs.select(F.col("snp2").alias("snp"), "snp1", "flip"), "snp")
    return g.select(F.col("snp1").alias("snp"), "indiv", *[flipped(F.col(a), F.col("flip")).alias(a) for a in ("a0", "a1")], "c0", "c1")


def merge_individuals(left_snps: DataFrame, left_geno: DataFrame, right_snps: DataFrame, right_geno: DataFrame) -> DataFrame:
    """Union of individuals over the variants that both panels have."""
    right = align_genotypes(left_snps, right_snps, right_geno)
    shared = align_snp(first_at_position(left_snps), first_at_position(right_snps)).select(F.col("snp1").alias("snp"))
    return left_geno.join(shared, "snp", "left_semi").select("snp", "indiv", "a0", "a1", "c0", "c1").unionByName(right)


def in_reference(snps: DataFrame, reference: DataFrame) -> DataFrame:
    """Variants whose (chrom, pos) the reference list has, in stored order."""
    return snps.join(reference.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def lift_over(snps: DataFrame, chain: DataFrame, width: int = 1_000_000) -> DataFrame:
    """snp, chrom, pos by chain blocks (chrom, start, stop, to_chrom, to_start, forward); -1 where a position maps nowhere, to several places or to no numbered chromosome (null)."""
    from .dataset import range_join

    hit = range_join(snps.select("snp", "chrom", "pos"), chain, "pos", "start", "stop", width, on=["chrom"])
    at = F.when(F.col("forward"), F.col("to_start") + F.col("pos") - F.col("start")).otherwise(F.col("to_start") + F.col("stop") - 1 - F.col("pos"))
    one = hit.groupBy("snp").agg(F.count("*").alias("_n"), F.first("to_chrom").alias("_c"), F.first(at).alias("_p")).where("_n = 1")
    return snps.join(one.where("_c IS NOT NULL"), "snp", "left").select("snp", F.coalesce("_c", F.lit(-1)).alias("chrom"), F.coalesce("_p", F.lit(-1)).alias("pos"))


def lifted(table: DataFrame, chain: DataFrame, keep_chrom: bool = False, width: int = 1_000_000) -> DataFrame:
    """The rows of a table with chrom and pos at their new places; those that don't map to one place are left out. With
    ``keep_chrom`` only the position changes."""
    places = table.select("chrom", "pos").distinct()
    moved = lift_over(places.select(F.struct("chrom", "pos").alias("snp"), "chrom", "pos"), chain, width).where("pos <> -1")
    moved = moved.select(F.col("snp.chrom").alias("chrom"), F.col("snp.pos").alias("pos"), F.col("chrom").alias("_c"), F.col("pos").alias("_p"))
    to = {"chrom": F.col("chrom" if keep_chrom else "_c"), "pos": F.col("_p")}
    return table.join(moved, ["chrom", "pos"]).select(*[to.get(c, F.col(c)).alias(c) for c in table.columns])


def sorted_variants(snps: DataFrame) -> DataFrame:
    """Variants in the order of chrom, pos and then of their numbers: snp counts from 0 in that order, from_snp is the old number."""
    from ..functions.ordering import dense_index

    return dense_index(snps.withColumnRenamed("snp", "from_snp"), ["chrom", "pos", "from_snp"], "snp")


def interpolate_genetic(snps: DataFrame, gmap: DataFrame) -> DataFrame:
    """Add ``cm``: piecewise linear on the map's knots (chrom, position, cm), by the edge segments outside of them.

    An as-of join: knots carry the next knot along; a variant takes the last
    knot at or before it (the first segment before all, the last one after).
    """
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("position")
    knots = gmap.select("chrom", "position", "cm", F.lead("position").over(w).alias("_p1"), F.lead("cm").over(w).alias("_c1"), F.lag("position").over(w).alias("_pp"), F.lag("cm").over(w).alias("_pc"))
    # The last knot stands for the segment before it.
    seg = F.when(F.col("_p1").isNotNull(), F.struct(F.col("position").alias("p0"), F.col("cm").alias("c0"), F.col("_p1").alias("p1"), F.col("_c1").alias("c1"))).otherwise(F.struct(F.col("_pp").alias("p0"), F.col("_pc").alias("c0"), F.col("position").alias("p1"), F.col("cm").alias("c1")))
    knots = knots.select("chrom", F.col("position").alias("pos"), seg.alias("_seg"))
    line = snps.select("chrom", "pos", "snp", F.lit(None).cast(knots.schema["_seg"].dataType).alias("_seg")).unionByName(knots.withColumn("snp", F.lit(None).cast(snps.schema["snp"].dataType)))
    order = Window.partitionBy("chrom").orderBy("pos", F.col("snp").isNotNull())
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    found = line.withColumn("_s", F.coalesce(F.last("_seg", ignorenulls=True).over(back), F.first("_seg", ignorenulls=True).over(ahead))).where("snp IS NOT NULL")
    s = F.col("_s")
    slope = F.try_divide(s["c1"] - s["c0"], (s["p1"] - s["p0"]).cast("double"))
    cm = found.select("snp", (s["c0"] + (F.col("pos") - s["p0"]) * slope).alias("cm"))
    return snps.join(cm, "snp", "left")
