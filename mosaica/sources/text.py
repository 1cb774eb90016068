"""Readers and writers of the text interchange formats.

Files are read in Spark's splits, whatever their size. Where a line's number in
its file matters it is made from the splits: lines before the split, counted,
and the line's place in it. Parquet is the store for panels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType

from ..operators.frames import counted

META = "##"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 0), value: the non-empty lines of each file, numbered in order.

    Rows of a split have consecutive numbers in their task, so a line's place in
    its split is a difference; the table of splits has one row for each of them.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = counted(splits.select("file", "_block", "_first", before.alias("_before")))
    numbered = raw.join(splits, ["file", "_block"])
    return numbered.select("file", (F.col("_id") - F.col("_first") + F.col("_before")).cast("long").alias("line"), "value").where("value <> ''")


def expand(path: str, spark: SparkSession) -> list[str]:
    """A data path, or a text list of paths, as a list (Spark itself expands directories and globs)."""
    if not path.endswith(".txt"):
        return [path]
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def _table(spark: SparkSession, path: str, header_mark: str, separator: str = "\t") -> tuple[DataFrame, list[str]]:
    body = lines(spark, path).where(~F.col("value").startswith(META))
    header = body.where(F.col("value").startswith(header_mark)).orderBy("line").first()
    names = header["value"].split("\t") if separator == "\t" else header["value"].split()
    rows = body.where(~F.col("value").startswith(header_mark)).select("line", F.split("value", separator).alias("_v"))
    return rows, names


def variants(spark: SparkSession, path: str) -> DataFrame:
    """Variant table (``#CHROM POS ID REF ALT ...``) -> snp (position in file), id, chrom, pos, ref, alt and further columns as text."""
    rows, names = _table(spark, path, "#CHROM")
    get = lambda n: F.col("_v")[names.index(n)]
    first = lines(spark, path).where(~F.col("value").startswith("#")).agg(F.min("line")).first()[0]
    extra = [get(n).alias(n) for n in names if n not in ("#CHROM", "POS", "ID", "REF", "ALT")]
    return rows.select((F.col("line") - F.lit(first or 0)).cast("long").alias("snp"), get("ID").alias("id"), F.regexp_replace(get("#CHROM"), "^chr", "").cast("int").alias("chrom"), get("POS").cast("long").alias("pos"), get("REF").alias("ref"), get("ALT").alias("alt"), *extra)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample table (``#IID ...``) -> indiv (position in file), id and further columns as text."""
    rows, names = _table(spark, path, "#IID")
    first = lines(spark, path).where(~F.col("value").startswith("#")).agg(F.min("line")).first()[0]
    return rows.select((F.col("line") - F.lit(first or 0)).cast("long").alias("indiv"), F.col("_v")[0].alias("id"), *[F.col("_v")[i].alias(n) for i, n in enumerate(names) if i])


def info(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A tab-separated table with a header; its first column becomes ``key``; NA is null; types are inferred."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=True, nullValue="NA")
    return df.withColumnRenamed(df.columns[0], key)


def attach_info(core: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Left join by key; a column that both have is an error."""
    both = (set(core.columns) & set(extra.columns)) - {key}
    if both:
        raise ValueError(f"columns exist already: {sorted(both)}")
    return core.join(extra, key, "left")


def whitespace_table(spark: SparkSession, path: str | list[str], names: list[str], header: bool = False) -> DataFrame:
    """Whitespace-separated columns by position (variant and family tables of other tools), several files together."""
    body = lines(spark, path)
    if header:
        body = body.where("line > 0")
    return body.select("file", "line", *[F.split(F.trim("value"), r"\s+")[i].alias(n) for i, n in enumerate(names)])


def bim(spark: SparkSession, path: str | list[str]) -> DataFrame:
    t = whitespace_table(spark, path, ["chrom", "id", "cm", "pos", "alt", "ref"])
    return t.select("file", "line", F.col("chrom").cast("int").alias("chrom"), "id", F.col("cm").cast("double").alias("cm"), F.col("pos").cast("long").alias("pos"), "alt", "ref")


def fam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return whitespace_table(spark, path, ["fid", "iid", "father", "mother", "sex", "pheno"])


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    t = whitespace_table(spark, path, ["chr", "position", "_rate", "cm"], header=True)
    return t.select(F.col("chr").cast("int").alias("chrom"), F.col("position").cast("long").alias("position"), F.col("cm").cast("double").alias("cm"))


def parse_digits(df: DataFrame, filter_non_numeric: bool = False) -> DataFrame:
    """(row, value of undelimited digits) -> row, col, value."""
    text = F.regexp_replace("value", "[^0-9]", "") if filter_non_numeric else F.col("value")
    cells = df.select("row", F.posexplode(F.filter(F.split(text, ""), lambda x: x != "")).alias("col", "value"))
    return cells.select("row", "col", F.col("value").cast("tinyint").alias("value"))


def read_digits(spark: SparkSession, path: str, filter_non_numeric: bool = False, n_rows: int | None = None) -> DataFrame:
    rows = lines(spark, path).select(F.col("line").alias("row"), "value")
    return parse_digits(rows.where(F.col("row") < n_rows) if n_rows is not None else rows, filter_non_numeric)


def write_digits(df: DataFrame, path: str) -> None:
    """(row, col, value) -> one line of digits per row."""
    packed = df.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("_c")).orderBy("row")
    packed.select(F.array_join(F.transform("_c", lambda x: x["value"].cast("string")), "").alias("value")).write.mode("overwrite").text(path)


def vcf(spark: SparkSession, path: str, region: tuple[int, int, int] | None = None, sample_names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(variants with INFO's R2 and MAF, genotypes snp, id, a0, a1) of a phased VCF; the first ALT only; a missing call is an error at use.

    ``region``: chrom, first and last position.
    """
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()["value"].split("\t")
    rows = lines(spark, path).where(~F.col("value").startswith("#")).select("line", F.split("value", "\t").alias("_v"))
    col = lambda n: F.col("_v")[header.index(n)]
    of_info = lambda n: F.regexp_extract(col("INFO"), rf"(?:^|;){n}=([^;]+)", 1).try_cast("double")
    base = rows.select(F.col("line").cast("long").alias("snp"), F.regexp_replace(col("#CHROM"), "^chr", "").cast("int").alias("chrom"), col("POS").cast("long").alias("pos"), col("ID").alias("id"), col("REF").alias("ref"), F.split(col("ALT"), ",")[0].alias("alt"), of_info("R2").alias("r2"), of_info("MAF").alias("maf"), "_v")
    if region:
        base = base.where((F.col("chrom") == region[0]) & F.col("pos").between(region[1], region[2]))
    wanted = [n for n in header[9:] if sample_names is None or n in sample_names]
    calls = F.array(*[F.struct(F.lit(n).alias("id"), F.split(F.split(col(n), ":")[0], r"[/|]").alias("g")) for n in wanted])
    geno = base.select("snp", F.inline(calls)).select("snp", "id", F.col("g")[0].cast("int").alias("a0"), F.col("g")[1].cast("int").alias("a1"))
    return base.drop("_v"), geno


def significant(c: Column, digits: int = 6) -> Column:
    """A number as %.<digits>g writes it (rounded from its binary value, an exact tie to the even digit), null and NaN as NA."""

    def written(numbers: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in numbers:
            yield pa.array([None if v is None or v != v else f"%.{digits}g" % v for v in x.to_pylist()], pa.string())

    return F.coalesce(F.arrow_udf(written, "string", ArrowUDFType.SCALAR_ITER)(c.cast("double")), F.lit("NA"))


def write_table(df: DataFrame, path: str, digits: int = 6) -> None:
    """Tab-separated with header; floats with so many significant digits; null is NA."""
    cols = [significant(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema]
    df.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def append_columns(spark: SparkSession, path: str, df: DataFrame, key: str, out: str) -> None:
    """Join new columns to a table at ``path`` by equal keys, and write to ``out``; columns must be new and keys the same."""
    old = info(spark, path, key)
    if set(old.columns) & (set(df.columns) - {key}):
        raise ValueError("columns exist already")
    a, b = old.select(key), df.select(key)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("keys differ")
    write_table(old.join(df, key), out, 8)
