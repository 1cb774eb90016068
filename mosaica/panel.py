"""The panel: genotypes with local ancestry, variants and individuals as DataFrames.

``geno`` has one row per (snp, indiv): alleles a0, a1 (null where missing) and
ancestry codes c0, c1 of the two haplotypes. ``snps`` and ``indivs`` carry any
columns beside their key. ``snp`` is a stored position in file order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    geno: DataFrame
    snps: DataFrame
    indivs: DataFrame
    n_anc: int

    def persist(self) -> Panel:
        return replace(self, geno=self.geno.persist(StorageLevel.MEMORY_AND_DISK))

    def where_snps(self, condition) -> Panel:
        """Variants that satisfy a condition; the genotypes follow by a semi-join."""
        snps = self.snps.where(condition)
        return replace(self, snps=snps, geno=self.geno.join(snps.select("snp"), "snp", "left_semi"))

    def where_indivs(self, condition) -> Panel:
        indivs = self.indivs.where(condition)
        return replace(self, indivs=indivs, geno=self.geno.join(indivs.select("indiv"), "indiv", "left_semi"))

    def slice(self, snp_start: int | None = None, snp_stop: int | None = None, indiv_start: int | None = None, indiv_stop: int | None = None) -> Panel:
        """Half-open positional slices of either axis: filters on stored positions, which reach the scan."""
        out = self
        for axis, start, stop in (("snp", snp_start, snp_stop), ("indiv", indiv_start, indiv_stop)):
            cond = F.lit(True)
            if start is not None:
                cond = cond & (F.col(axis) >= start)
            if stop is not None:
                cond = cond & (F.col(axis) < stop)
            if start is not None or stop is not None:
                meta = "snps" if axis == "snp" else "indivs"
                out = replace(out, geno=out.geno.where(cond), **{meta: getattr(out, meta).where(cond)})
        return out

    def select_ids(self, axis: str, ids: DataFrame, id_column: str | None = None) -> Panel:
        """Rows of the listed ids; ids that the panel lacks raise KeyError."""
        meta = self.snps if axis == "snp" else self.indivs
        column = id_column or axis
        wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        missing = wanted.join(meta, column, "left_anti").limit(3).collect()
        if missing:
            raise KeyError(f"not in the panel: {[r[0] for r in missing]}")
        kept = meta.join(wanted, column, "left_semi")
        geno = self.geno.join(kept.select(axis), axis, "left_semi")
        return replace(self, geno=geno, **{"snps" if axis == "snp" else "indivs": kept})

    def reindexed(self, axis: str = "snp") -> Panel:
        """Positions made dense again after a subset, in stored order (variant and sample tables only are ordered)."""
        from .functions.ordering import dense_index

        meta = self.snps if axis == "snp" else self.indivs
        index = dense_index(meta.select(axis), axis, "_new")
        swap = lambda df: df.join(index, axis).drop(axis).withColumnRenamed("_new", axis)
        return replace(self, geno=swap(self.geno), **{"snps" if axis == "snp" else "indivs": swap(meta)})

    def append_indiv_info(self, info: DataFrame, force_update: bool = False) -> Panel:
        from .operators.dataset import append_info

        return replace(self, indivs=append_info(self.indivs, info, "indiv", force_update))

    def append_snp_info(self, info: DataFrame) -> Panel:
        from .operators.dataset import append_info

        return replace(self, snps=append_info(self.snps, info, "snp"))

    def summary(self) -> DataFrame:
        """n_snp, n_indiv, n_haplotype in one row."""
        n = self.snps.agg(F.count("*").alias("n_snp")).crossJoin(self.indivs.agg(F.count("*").alias("n_indiv")))
        return n.withColumn("n_haplotype", 2 * F.col("n_indiv")).withColumn("n_anc", F.lit(self.n_anc))

    def validate(self) -> None:
        """Raise ValueError where keys repeat, genotypes refer to unknown keys, or values are out of range."""
        for df, key in ((self.snps, ["snp"]), (self.indivs, ["indiv"]), (self.geno, ["snp", "indiv"])):
            if df.groupBy(*key).count().where("count > 1").limit(1).count():
                raise ValueError(f"{key} repeats")
        for key, meta in (("snp", self.snps), ("indiv", self.indivs)):
            if self.geno.join(meta.select(key), key, "left_anti").limit(1).count():
                raise ValueError(f"genotypes of an unknown {key}")
        anc = F.col("c0").between(0, self.n_anc - 1) & F.col("c1").between(0, self.n_anc - 1)
        bad = self.geno.where(~(anc & F.coalesce(F.col("a0").isin(0, 1), F.lit(True)) & F.coalesce(F.col("a1").isin(0, 1), F.lit(True))))
        if bad.limit(1).count():
            raise ValueError("alleles or ancestries out of range")
