"""Dense positions, ranks and running sums over whole tables without a window in one task.

Rows are range-partitioned by their order and handled inside their partition;
only one row for each partition is summed up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frames import written


def _ranged(df: DataFrame, by: list[str], parts: int | None) -> DataFrame:
    """Rows with ``_p``, the number of their range. Written, so that every use sees the same ranges."""
    cols = [F.col(c) for c in by]
    ranged = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    return written(ranged.withColumn("_p", F.spark_partition_id()))


def _before(parts: DataFrame, value: str, name: str) -> DataFrame:
    """(_p, value) of each range -> (_p, name): the sum over the ranges before it."""
    line = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_p", F.coalesce(F.sum(value).over(line), F.lit(0)).alias(name))


def dense_index(df: DataFrame, by: str | list[str], name: str, parts: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of ``by``."""
    by = [by] if isinstance(by, str) else by
    rows = _ranged(df, by, parts)
    inner = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1)
    offsets = _before(rows.groupBy("_p").agg(F.count("*").alias("_n")), "_n", "_o")
    return inner.join(offsets, "_p").withColumn(name, (F.col("_i") + F.col("_o")).cast("long")).drop("_p", "_i", "_o")


def running_sum(df: DataFrame, value: Column, by: list[str], name: str, inclusive: bool = True, parts: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows up to each in the order of ``by`` (distinct keys), with it or without."""
    rows = _ranged(df.withColumn("_v", value), by, parts)
    line = Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_s", F.sum("_v").over(line))
    if not inclusive:
        inner = inner.withColumn("_s", F.col("_s") - F.col("_v"))
    offsets = _before(rows.groupBy("_p").agg(F.sum("_v").alias("_t")), "_t", "_o")
    return inner.join(offsets, "_p").withColumn(name, F.col("_s") + F.col("_o")).drop("_p", "_s", "_o", "_v")


def average_rank(df: DataFrame, value: str, name: str, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Add ``name``: the average rank (from 1) of a value that is not null among those of its group; null stays null.

    Ranks come from the distinct values, each with its number of rows, so a
    value that very many rows share is one row here.
    """
    keys = keys or []
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = running_sum(values, F.col("_c"), [*keys, value], "_u", parts=parts)
    if keys:
        first = upto.groupBy(*keys).agg(F.min(F.col("_u") - F.col("_c")).alias("_f"))
        same = upto.alias("u").join(first.alias("f"), [F.col(f"u.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
        upto = same.select(*[F.col(f"u.{k}").alias(k) for k in keys], value, "_c", (F.col("_u") - F.col("_f")).alias("_u"))
    ranks = upto.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_value"), (F.col("_u") - (F.col("_c") - 1) / 2).alias(name))
    on = (F.col(value) == F.col("_value"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, on, "left").drop("_value", *[f"_k{i}" for i in range(len(keys))])
