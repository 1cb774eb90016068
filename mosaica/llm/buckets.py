"""Verified links inside hash buckets, without emitting all pairs of a bucket.

Rows (key, kind, ...) are dealt by key and sorted. ``kind`` 0 marks a row stored
under its own key, 1 a row that only probes the bucket. What leaves a bucket is
a spanning forest of its verified links, so a bucket of n near copies yields at
most n - 1 rows. Buckets above ``cap`` stored rows are split into a grid of
cells (``split_hot``) that many tasks share; every stored pair and every
stored-probe pair meets in exactly one cell, so nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small

SMALL_GROUP = 64
MAX_PAIRS = 1_000_000


def split_hot(rows: DataFrame, hot: DataFrame, salt: str) -> DataFrame:
    """Add ``cell``: 0 for rows of ordinary keys; rows of hot keys are repeated over a grid.

    hot: (key, gs, gp), the numbers of stored and probe blocks. A stored row of
    block i is the stored side of cells (i, c), c >= i, and the probing side of
    cells (c, i), c < i; a probe row of block p probes (c, gs + p) for every c.
    """
    hot, n = broadcast_if_small(hot)
    if not n:
        return rows.withColumn("cell", F.lit(0).cast("long"))
    cols = rows.columns
    g = F.col("gs") + F.col("gp")
    block = F.when(F.col("kind") == 0, F.pmod(F.xxhash64(salt), F.col("gs"))).otherwise(F.col("gs") + F.pmod(F.xxhash64(salt), F.greatest("gp", F.lit(1))))
    joined = rows.join(hot, "key", "left").withColumn("_b", block)
    as_stored = F.when(F.col("kind") == 0, F.transform(F.sequence("_b", g - 1), lambda c: F.struct((F.col("_b") * g + c).alias("cell"), F.lit(0).alias("kind"))))
    last = F.when(F.col("kind") == 0, F.col("_b")).otherwise(F.col("gs"))
    as_probe = F.when(last > 0, F.transform(F.sequence(F.lit(0).cast("long"), last - 1), lambda c: F.struct((c * g + F.col("_b")).alias("cell"), F.lit(1).alias("kind"))))
    cell = F.when(
        F.col("gs").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.col("kind").cast("int").alias("kind")))
    ).otherwise(F.concat(F.coalesce(as_stored, F.array()), F.coalesce(as_probe, F.array())))
    return joined.withColumn("_c", F.explode(cell)).select(*[c for c in cols if c != "kind"], F.col("_c.kind").alias("kind"), F.col("_c.cell").alias("cell"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of one (key, cell) together in one task and next to each other, stored rows first."""
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "kind")


def groups(frames: Iterator, columns: list[str], rows: int = 60_000) -> Iterator[dict[str, np.ndarray]]:
    """Arrow batches sorted by (key, cell) -> chunks of numpy columns that end at a group's end."""
    held: list[dict] = []
    n = 0

    def flush(chunks: list[dict]) -> dict:
        return {c: np.concatenate([x[c] for x in chunks]) for c in chunks[0]}

    for batch in frames:
        if not batch.num_rows:
            continue
        held.append({c: column(batch, c) for c in columns})
        n += batch.num_rows
        if n >= rows:
            all_ = flush(held)
            k, c = all_["key"], all_["cell"]
            change = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1]))
            if len(change):
                cut = change[-1] + 1
                yield {x: v[:cut] for x, v in all_.items()}
                held = [{x: v[cut:] for x, v in all_.items()}]
                n = len(k) - cut
            else:
                held = [all_]
    if n:
        yield flush(held)


def column(batch, name: str) -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(name))
    if str(c.type).startswith("list"):
        flat = c.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(c), -1) if len(c) else flat.reshape(0, 0)
    return c.to_numpy(zero_copy_only=False)


def bounds(chunk: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = chunk["key"], chunk["cell"]
    starts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1))
    return starts, np.append(starts[1:], len(k))


def forest(chunk: dict[str, np.ndarray], pairs_ok: Callable, row_ok: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of verified links that span each group's verified link graph.

    Small groups list their stored-stored and stored-probe pairs at once; larger
    ones walk breadth first, comparing each row once with those not yet reached.
    """
    starts, ends = bounds(chunk)
    kind = chunk["kind"]
    stored = np.add.reduceat((kind == 0).astype(np.int64), starts)
    sizes = ends - starts
    out_i: list[np.ndarray] = []
    out_j: list[np.ndarray] = []
    use = (stored > 0) & (sizes > 1)
    small = use & (sizes <= SMALL_GROUP)
    if small.any():
        s, e, m = starts[small], ends[small], stored[small]
        rows = np.concatenate([np.arange(a, b) for a, b in zip(s, e, strict=True)])
        stored_end = np.repeat(s + m, e - s)
        first = np.where(kind[rows] == 0, rows + 1, np.repeat(s, e - s))
        count = np.maximum(stored_end - first, 0)
        for a in range(0, len(rows), 20_000):
            n = count[a : a + 20_000]
            i = np.repeat(rows[a : a + 20_000], n)
            j = np.repeat(first[a : a + 20_000], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ok = pairs_ok(i, j)
            out_i.append(i[ok])
            out_j.append(j[ok])
    for a, b in zip(starts[use & ~small], ends[use & ~small], strict=True):
        todo = np.arange(a, b)
        while len(todo) > 1:
            stack, todo = [todo[0]], todo[1:]
            while stack and len(todo):
                i = stack.pop()
                # Two probes don't meet: a probe is compared with stored rows only.
                meets = np.ones(len(todo), bool) if kind[i] == 0 else kind[todo] == 0
                ok = np.zeros(len(todo), bool)
                ok[meets] = row_ok(i, todo[meets])
                found = todo[ok]
                if len(found):
                    out_i.append(np.full(len(found), i))
                    out_j.append(found)
                    stack.extend(found.tolist())
                    todo = todo[~ok]
    none = np.empty(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)
