"""Binary formats: lower-triangular kernels and two-bit genotypes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ensure_on_workers
from ..operators.frames import discard, written
from .text import whitespace_table

BED_MAGIC = b"\x6c\x1b\x01"
_STEP = 1 << 20


def ranges(spark: SparkSession, path: str, header: int, record: int, fn: Callable[[int, bytes], pa.RecordBatch], schema: str, step: int = _STEP, most: int | None = None) -> DataFrame:
    """A file of ``header`` bytes and fixed records, read by many tasks: fn(number of the first record, bytes) of every range (the first ``most``).

    Only the length comes from the file's listing; each task opens the file at its own ranges.
    """
    ensure_on_workers(spark)
    path, length = spark.read.format("binaryFile").load(path).select("path", "length").first()
    n = (length - header) // record
    if header + n * record != length:
        raise ValueError(f"{path}: {length} bytes are no whole number of records")
    rows = max(1, step // record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        with system.open_input_file(name) as f:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    first = part * rows
                    yield fn(first, f.read_at(min(rows, n - first) * record, header + first * record))

    parts = min(-(-n // rows), most or n)
    return spark.range(0, parts, 1, max(1, min(parts, 10_000))).mapInArrow(run, schema)


def read_kernel(spark: SparkSession, prefix: str, step: int = _STEP) -> tuple[DataFrame, DataFrame]:
    """(i, j, value), ids (i, fid, iid) from <prefix>.grm.bin (float32, lower triangle by rows) and .grm.id."""

    def decoded(first: int, data: bytes) -> pa.RecordBatch:
        v = np.frombuffer(data, "<f4")
        k = np.arange(first, first + len(v), dtype=np.int64)
        i = ((np.sqrt(8.0 * k + 1) - 1) / 2).astype(np.int64)
        i += (i + 1) * (i + 2) // 2 <= k  # roots of large numbers may be one off
        i -= i * (i + 1) // 2 > k
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(k - i * (i + 1) // 2), pa.array(v.astype(float))], ["i", "j", "value"])

    kernel = ranges(spark, f"{prefix}.grm.bin", 0, 4, decoded, "i long, j long, value double", step)
    ids = whitespace_table(spark, f"{prefix}.grm.id", ["fid", "iid"]).select(F.col("line").cast("long").alias("i"), "fid", "iid")
    return kernel, ids


def write_kernel(kernel: DataFrame, ids: list[tuple[str, str]], n_snp: int, prefix: str) -> None:
    """<prefix>.grm.bin, .grm.N.bin and .grm.id. Every entry of the lower triangle has to be there once.

    Tasks sort ranges of entries and encode them in blocks of bytes, whose table is
    written; as the format is one file, the driver puts the blocks together, one
    partition of them at a time.
    """
    ensure_on_workers(kernel.sparkSession)
    place = (F.expr("i * (i + 1) DIV 2") + F.col("j")).alias("k")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            if len(k):
                if (np.diff(k) != 1).any():
                    raise ValueError("kernel entries are missing or repeat")
                data = batch.column(1).to_numpy().astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(k[0])]), pa.array([len(k)]), pa.array([data], pa.binary())], ["k", "n", "data"])

    rows = kernel.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("value").cast("double")).select(place, "value")
    blocks = written(rows.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(encoded, "k long, n long, data binary"))
    at = 0
    with open(f"{prefix}.grm.bin", "wb") as out, open(f"{prefix}.grm.N.bin", "wb") as counts:
        for row in blocks.orderBy("k").toLocalIterator():
            if row["k"] != at:
                raise ValueError("kernel entries are missing or repeat")
            at += row["n"]
            out.write(row["data"])
            counts.write(np.full(row["n"], n_snp, "<f4").tobytes())
    discard(blocks)
    if at != len(ids) * (len(ids) + 1) // 2:
        raise ValueError(f"{at} entries for {len(ids)} people")
    with open(f"{prefix}.grm.id", "w") as out:
        out.writelines(f"{f}\t{i}\n" for f, i in ids)


def read_bed(spark: SparkSession, path: str, n_indiv: int, step: int = _STEP) -> DataFrame:
    """snp, indiv, g: counts of the first allele in the variant table from a two-bit file in variant order; null where missing."""
    width = (n_indiv + 3) // 4
    codes = np.array([2, -1, 1, 0], np.int8)

    def magic(first: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([data])], ["m"])

    if ranges(spark, path, 0, 1, magic, "m binary", 3, most=1).first()[0] != BED_MAGIC:
        raise ValueError("not a variant-major two-bit genotype file")

    def decoded(first: int, data: bytes) -> pa.RecordBatch:
        body = np.frombuffer(data, np.uint8).reshape(-1, width)
        g = codes[np.stack([(body >> s) & 3 for s in (0, 2, 4, 6)], 2).reshape(len(body), -1)[:, :n_indiv]].ravel()
        snp = np.repeat(np.arange(first, first + len(body), dtype=np.int64), n_indiv)
        return pa.RecordBatch.from_arrays([pa.array(snp), pa.array(np.tile(np.arange(n_indiv, dtype=np.int64), len(body))), pa.array(g.astype(np.int32), mask=g < 0)], ["snp", "indiv", "g"])

    return ranges(spark, path, 3, width, decoded, "snp long, indiv long, g int", step // 4)
