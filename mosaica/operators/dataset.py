"""Filters, checks and maintenance of variant and individual tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-8
RELATIVE = 1e-5


def frequency_filter(info: DataFrame, columns: list[str], maf: float) -> DataFrame:
    """Every frequency in [maf, 1 - maf], bounds included; null frequencies fail."""
    return info.where(reduce(lambda a, b: a & b, [F.col(c).between(maf, 1 - maf) for c in columns]))


def listed(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a listed id, and the listed ids that ``df`` lacks."""
    wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
    return df.join(wanted, column, "left_semi"), wanted.join(df, column, "left_anti")


def with_phenotype(indivs: DataFrame, pheno: str, covariates: list[str]) -> DataFrame:
    """Rows with a phenotype and at least one covariate (if there are any)."""
    keep = F.col(pheno).isNotNull()
    if covariates:
        keep = keep & F.coalesce(*[F.col(c).cast("string") for c in covariates]).isNotNull()
    return indivs.where(keep)


def of_population(indivs: DataFrame, superpop: list[str] | str | None = None, pop: list[str] | str | None = None, exclude_pop: list[str] | str | None = None) -> DataFrame:
    if (superpop is None) == (pop is None):
        raise ValueError("give either superpop or pop")
    many = lambda x: [x] if isinstance(x, str) else list(x)
    out = indivs.where(F.col("superpop").isin(many(superpop)) if superpop is not None else F.col("pop").isin(many(pop)))
    return out.where(~F.col("pop").isin(many(exclude_pop))) if exclude_pop is not None else out


def close(a: Column, b: Column) -> Column:
    """Equal up to tolerance for numbers, equal otherwise; two nulls are equal."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= TOLERANCE + RELATIVE * F.abs(b), F.lit(False))


def same_values(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per common column: the number of keys whose values differ."""
    numeric = {f.name for f in old.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")}
    j = old.alias("o").join(new.alias("n"), key)
    equal = lambda c: close(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in numeric else F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    wide = j.agg(*[F.sum((~equal(c)).cast("long")).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(0)).alias("n_differ")) for c in columns])))


def append_info(meta: DataFrame, info: DataFrame, key: str, force_update: bool = False) -> DataFrame:
    """Left-join new columns by key. A column that exists must agree unless ``force_update`` replaces it."""
    common = [c for c in info.columns if c in meta.columns and c != key]
    if common and not force_update:
        bad = [r["column"] for r in same_values(meta, info, key, common).where("n_differ > 0").collect()]
        if bad:
            raise ValueError(f"columns exist with other values: {bad}")
        info = info.drop(*common)
    return meta.drop(*(common if force_update else [])).join(info, key, "left")


def differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of (columns) that one table has and the other hasn't, with multiplicity; none if they are aligned."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def is_aligned(tables: list[DataFrame], columns: list[str]) -> bool | None:
    """Whether all tables agree on (position, columns); None for no table."""
    if not tables:
        return None
    return all(differences(tables[0], t, columns).limit(1).count() == 0 for t in tables[1:])


def dummies(df: DataFrame, column: str, levels: list | None = None) -> DataFrame:
    """One-hot columns <column>_<level>, the first sorted level dropped; null stays null. Levels are few by nature: a
    category of a covariate table; they are read from the table unless given."""
    if levels is None:
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(10_001).collect()]
        if len(levels) > 10_000:
            raise ValueError(f"{column} has over 10,000 levels and is no category")
    made = [F.when(F.col(column).isNotNull(), (F.col(column) == lv).cast("int")).alias(f"{column}_{lv}") for lv in levels[1:]]
    return df.select(*[c for c in df.columns if c != column], *made)


def categorical(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("string", "boolean")]


def range_join(points: DataFrame, ranges: DataFrame, pos: str, start: str, stop: str, width: int, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points x ranges where start <= pos < stop, as an equi-join on bins of ``width`` (a range fills the bins it meets)."""
    b = ranges.where(F.col(start) < F.col(stop)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    a = points.withColumn("_bin", F.floor(F.col(pos) / width))
    cond = (a["_bin"] == b["_bin"]) & (a[pos] >= b[start]) & (a[pos] < b[stop])
    for c in on or []:
        cond = cond & (a[c] == b[c])
    j = a.join(b, cond, how)
    return j.select(*[a[c] for c in points.columns], *[b[c] for c in ranges.columns if c not in (on or [])])


def ld_blocks(snps: DataFrame, blocks: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Each variant's block (start <= pos < stop on its chromosome)."""
    return range_join(snps, blocks, "pos", "start", "stop", width, on=["chrom"])


def unrelated(indivs: DataFrame, related: DataFrame, key: str = "indiv") -> DataFrame:
    return indivs.join(related.select(key).distinct(), key, "left_anti")


def first_at_position(snps: DataFrame) -> DataFrame:
    """The first variant of each (chrom, pos)."""
    w = Window.partitionBy("chrom", "pos").orderBy("snp")
    return snps.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def sorted_breaks(snps: DataFrame) -> DataFrame:
    """chrom, n, n_unsorted: places where the position falls in stored order."""
    w = Window.partitionBy("chrom").orderBy("snp")
    falls = (F.lag("pos").over(w) > F.col("pos")).cast("long")
    return snps.withColumn("_f", F.coalesce(falls, F.lit(0))).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("_f").alias("n_unsorted"))


def quality_control(snps: DataFrame, counts: DataFrame, mac: int = 5) -> DataFrame:
    """Single-base, biallelic variants, once by (chrom, pos, ref, alt), with a minor allele count of at least ``mac``.
    counts: snp, ac (alternative alleles), an (alleles)."""
    one = F.count("*").over(Window.partitionBy("chrom", "pos", "ref", "alt")) == 1
    minor = F.least("ac", F.col("an") - F.col("ac"))
    return snps.where("length(ref) = 1 AND length(alt) = 1").withColumn("_one", one).where("_one").drop("_one").join(counts, "snp").where(minor >= mac)


def variant_id() -> Column:
    return F.concat_ws(":", "chrom", "pos", "ref", "alt")


def seed_of(text: Column) -> Column:
    """The low 32 bits of a text's SHA-256."""
    return F.conv(F.right(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long")


def natural_key(name: str) -> tuple:
    """Order key of a file prefix: its digits as numbers."""
    import re

    return tuple(int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name))


def is_number(x: float | None) -> bool:
    return x is not None and math.isfinite(x)
