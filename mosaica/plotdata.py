"""What plots show, as DataFrames: no drawing library is needed to compute it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.stats import curve_probability, hdi, manhattan, mode, qq

__all__ = ["admixture_bars", "ancestry_tracks", "manhattan", "pca_labels", "posterior_curve", "qq", "susie", "through_origin"]


def through_origin(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """slope of the line through the origin that compares two sets of values."""
    return df.agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"))


def pca_labels(pcs: DataFrame, x: str = "pc1", y: str = "pc2") -> DataFrame:
    """Where each population's label stands: the medians of its points."""
    return pcs.groupBy("pop").agg(F.percentile(x, F.lit(0.5)).alias(x), F.percentile(y, F.lit(0.5)).alias(y), F.count("*").alias("n"))


def ancestry_tracks(segments: DataFrame, first: int = 10) -> DataFrame:
    """indiv, ploidy, start, stop, anc of the first people: a picture of ten tracks is the feature."""
    sides = F.array(*[F.struct(F.lit(h).alias("ploidy"), F.col(f"anc{h}").alias("anc")) for h in (0, 1)])
    return segments.where(F.col("indiv") < first).select("indiv", F.inline(sides), "start", "stop")


def admixture_bars(proportions: DataFrame, names: list[str]) -> DataFrame:
    """Stacked bars: bottom and top of each ancestry's share, people ordered by their largest ancestry."""
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    order = Window.partitionBy("_main").orderBy(F.desc("_top"), "indiv")
    main = F.coalesce(*[F.when(F.col(n) == top, F.lit(n)) for n in names])
    ranked = proportions.withColumn("_top", top).withColumn("_main", main).withColumn("place", F.row_number().over(order))
    below, parts = F.lit(0.0), []
    for n in names:
        parts.append(F.struct(F.lit(n).alias("ancestry"), below.alias("bottom"), (below + F.col(n)).alias("top")))
        below = below + F.col(n)
    return ranked.select("indiv", F.col("_main").alias("main"), "place", F.inline(F.array(*parts)))


def susie(pips: DataFrame, sets: DataFrame) -> DataFrame:
    """Posterior inclusion by variant, with its credible set if it has one."""
    return pips.join(sets.select("snp", F.col("set").alias("credible_set")), "snp", "left")


def posterior_curve(curve: DataFrame, keys: list[str], ci: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curve with probabilities, modes, intervals of highest density)."""
    return curve_probability(curve, keys), mode(curve, keys, "rg"), hdi(curve, keys, "rg", ci)
