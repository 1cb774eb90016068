"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ensure_on_workers

#: ASCII white space as the word contracts define it: a word is [^\x20\x09-\x0D]+.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local master may do without and gets one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> tuple[DataFrame, int]:
    """A materialised ``df``, hinted for broadcast only if its counted size allows it."""
    df = materialize(df)
    n = df.count()
    return (F.broadcast(df) if n <= max_rows else df), n


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of a slice has about ``limit`` bytes (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def pieces(keys: pa.RecordBatch, found: list[tuple | None], kinds: list[pa.DataType], names: list[str], longest: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows of sparse arrays (None: left out) as rows of at most ``longest`` entries with a ``part`` number, so that a batch
    of rows is bounded whatever the texts are."""
    import numpy as np

    out = [(i, part, [a[part * longest : (part + 1) * longest] for a in arrays]) for i, arrays in enumerate(found) if arrays is not None for part in range(max(1, -(-len(arrays[0]) // longest)))]
    if out:
        take = pa.array([o[0] for o in out])
        lists = [pa.array([o[2][k] for o in out], pa.list_(kind)) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in keys.columns), pa.array(np.array([o[1] for o in out], np.int32)), *lists], [*keys.schema.names, "part", *names])


def joined(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[dict]:
    """Pieces in order, put together again: a dict of each row, its arrays as numpy."""
    import numpy as np

    row: dict | None = None
    for batch in batches:
        plain = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c not in names}
        lists = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
        for i in range(batch.num_rows):
            if row is None or any(row[k] != plain[k][i] for k in keys):
                if row is not None:
                    yield row | {c: np.concatenate(row[c]) for c in names}
                row = {c: v[i] for c, v in plain.items()} | {c: [] for c in names}
            for c in names:
                row[c].append(lists[c][i].values.to_numpy(zero_copy_only=False))
    if row is not None:
        yield row | {c: np.concatenate(row[c]) for c in names}


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package on the workers."""
    ensure_on_workers(df.sparkSession)
    return df.mapInArrow(fn, schema)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that ``materialize_table`` wrote inside; what is needed later must be written or counted before."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in made:
            where = hadoop.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize_table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder (columnar, so smaller than a checkpoint).

    ``rows``: a bound on its rows, where known. A small table is then written by few tasks, 50,000 rows each or 12 in all,
    as each file costs its executor some processes on a local file system.
    """
    if rows is not None:
        df = df.coalesce(max(12, -(-rows // 50_000)))
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _SCOPES[-1:]:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", total: int | None = None, parts: int = 1024, least: int = 256) -> DataFrame:
    """``big.join(small, on, how)`` where a few keys may hold much of ``big``; ``big`` should be a written table, as it is read twice.

    Keys of more than 1 / ``parts`` of big's rows (``total``, counted unless given, and more than ``least``) are hot:
    there are fewer than ``parts`` of them, so their list is small. A hot key's rows are dealt over salts by a hash of
    their ``by`` columns and small's rows of that key are repeated for each salt, so no task gets a whole hot key.
    """
    total = big.count() if total is None else total
    limit = max(least, total // parts)
    hot = [] if total <= limit else big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")).limit(parts).collect()
    if not hot:
        return big.join(small, on, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(hot, ", ".join(f"{c} {big.schema[c].dataType.simpleString()}" for c in on) + ", _salts int"))
    salts = F.coalesce("_salts", F.lit(1))
    b = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    s = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return b.join(s, [*on, "_salt"], how).drop("_salt")
