"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Candidates: in each of ``tables`` tables a vector is turned by ``hashes`` fast
pseudo-random rotations (sign flips and Hadamard transforms); each gives the
axis its image lies nearest to, and the axes together with the label are its
bucket. Besides its own bucket a vector probes those that lie next nearest.
What goes to the buckets is a vector's number and a sketch of 128 signs of
random projections, not the vector: candidates in a bucket are pairs whose
sketches differ in no more bits than a linked pair's can, and a bucket yields a
spanning forest of them.

Links: any linked pair lies in one component of those forests, so each vector is
sent once, to its component, and all pairs there are verified by their cosine in
double precision, in blocks (pairs are compared, never emitted): this gives the
number of links and a spanning forest of the verified links, whose components
are the result. A component of n distinct vectors costs n^2 / 2 comparisons,
spread over (n / cap)^2 / 2 cells, as n_links is asked for each of them; equal
vectors are one row with a count and cost nothing.

Recall: at cosine 0.98 one table of two hashes with four probes misses 13 % of
pairs from either side, and six tables miss less than one in 100,000; sketches
miss fewer than one in a billion (eight deviations).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .common import map_arrow, materialize_table, spread_join
from .components import connected_components


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (width a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signs(dim: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, dim))


def probes(x: np.ndarray, flips: np.ndarray, count: int, near: int = 4) -> np.ndarray:
    """(rows, count) bucket numbers of one table, nearest first; the first is the row's own."""
    n, d = x.shape
    side, loss = [], []
    for flip in flips:
        y = x
        for f in flip:
            y = hadamard(y * f)
        full = np.concatenate((y, -y), axis=1)
        best = np.argpartition(-full, near, axis=1)[:, :near]
        value = np.take_along_axis(full, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        side.append(np.take_along_axis(best, order, 1))
        value = np.take_along_axis(value, order, 1)
        loss.append((value[:, :1] - value) ** 2)
    codes, losses = [], []
    for pick in product(range(near), repeat=len(flips)):
        code = np.zeros(n, np.int64)
        for s, p in zip(side, pick, strict=True):
            code = code * (2 * d) + s[:, p]
        codes.append(code)
        losses.append(sum(q[:, p] for q, p in zip(loss, pick, strict=True)))
    order = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, :count]
    return np.take_along_axis(np.stack(codes, 1), order, 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    # Scaled by the largest component first, so that tiny and huge vectors keep their precision.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(dots(x.T, x.T))[:, None]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column-wise products of (width, n) arrays, summed in one order, so that equal vectors give equal sums wherever they stand."""
    out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    for i in range(a.shape[0]):
        out += a[i] * b[i]
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero and has only finite components (vec_id, label, embedding as doubles)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label") if "label" in embeddings.columns else F.lit(0).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0))


SKETCH = 128


def sketch_limit(least: float) -> int:
    """The most bits in which sketches of linked vectors differ, but for one pair in a billion: binomial mean and eight deviations."""
    p = float(np.arccos(min(1.0, max(-1.0, least))) / np.pi)
    return min(SKETCH, int(np.ceil(SKETCH * p + 8 * np.sqrt(SKETCH * p * (1 - p)))))


def _indexed(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, count: int, seed: int) -> Iterator[pa.RecordBatch]:
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part, x_ in by_width(batches, 1024):
        label = part.column(part.schema.get_field_index("label_id")).to_numpy().view(np.uint64)
        rep = part.column(part.schema.get_field_index("rep")).to_numpy()
        n, w = x_.shape
        d = 1 << int(w - 1).bit_length()
        x = np.zeros((n, d))
        x[:, :w] = x_
        if w not in known:
            known[w] = (signs(d, tables, hashes, seed), np.random.default_rng(seed).normal(size=(w, SKETCH)))
        flips, planes = known[w]
        sketch = np.packbits(x_ @ planes > 0, axis=1).view(np.int64)
        for t in range(tables):
            found = probes(x, flips[t], count, min(4, 2 * d - 1)).astype(np.uint64)
            with np.errstate(over="ignore"):
                # 64 bits for (label, width, table, bucket): a chance meeting of two costs a comparison, no more.
                k = ((label[:, None] * np.uint64(31) + np.uint64(w * 64 + t)) * np.uint64(0x9E3779B97F4A7C15)) ^ (found * np.uint64(0xC2B2AE3D27D4EB4F))
            who = np.repeat(np.arange(n), found.shape[1])
            kinds = np.tile(np.minimum(np.arange(found.shape[1]), 1), n)
            columns = [k.reshape(-1).view(np.int64), kinds.astype(np.int32), rep[who], label.view(np.int64)[who], sketch[who, 0], sketch[who, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "kind", "rep", "label_id", "s0", "s1"])


def by_width(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices whose vectors have one width, with those as unit vectors."""
    for batch in batches:
        for row in range(0, batch.num_rows, rows):
            part = batch.slice(row, rows)
            width = pc.list_value_length(part.column(part.schema.get_field_index("embedding"))).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                same = part if (width == w).all() else part.filter(pa.array(width == w))
                yield same, unit_rows(same)


def unit_rows(part: pa.RecordBatch) -> np.ndarray:
    """Unit vectors of a slice whose vectors have one width."""
    c = part.column(part.schema.get_field_index("embedding"))
    return unit(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1))


def _candidates(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for chunk in buckets.groups(batches, ["key", "cell", "kind", "rep", "label_id", "s0", "s1"]):
        label, rep, a, b = chunk["label_id"], chunk["rep"], chunk["s0"].view(np.uint64), chunk["s1"].view(np.uint64)

        def near(i, j, label=label, a=a, b=b):
            return (label[i] == label[j]) & (np.bitwise_count(a[i] ^ a[j]).astype(np.int32) + np.bitwise_count(b[i] ^ b[j]) <= limit)

        i, j = buckets.forest(chunk, near, near)
        ok = rep[i] != rep[j]
        yield pa.RecordBatch.from_arrays([pa.array(rep[i[ok]]), pa.array(rep[j[ok]])], ["u", "v"])


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which unit rows of x and y have a cosine of ``least``: by a product of matrices, and where rounding could decide, by the fixed-order sum."""
    g = x @ y.T
    near = g >= least
    i, j = np.nonzero(np.abs(g - least) < 1e-12)
    if len(i):
        near[i, j] = dots(x[i].T, y[j].T) >= least
    return near


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Inside cells of components: (rep, -1, links) partial link counts of stored rows against each other and against
    probing rows, and (rep, other, 0) a spanning forest of the verified links."""
    for chunk, x in _chunks(batches, ["key", "cell", "kind", "rep", "label_id", "copies"]):
        starts, ends = buckets.bounds(chunk)
        links = np.zeros(len(x), np.int64)
        copies, label, rep, size = chunk["copies"], chunk["label_id"], chunk["rep"], chunk["_width"]
        us, vs = [], []
        for a, b in zip(starts, ends, strict=True):
            s = a + int((chunk["kind"][a:b] == 0).sum())
            tree = np.arange(a, b)
            # A cell off the grid's diagonal has probing rows: there only they meet the stored ones, whose own pairs are counted on the diagonal.
            for p in range(s if s < b else a, b, 1024):
                q = min(b, p + 1024)
                near = linked(x[p:q], x[a:s], least) & (label[p:q, None] == label[None, a:s]) & (size[p:q, None] == size[None, a:s])
                if s == b:
                    near[np.arange(q - p), np.arange(p, q) - a] = False
                else:
                    links[a:s] += copies[p:q] @ near
                links[p:q] += near @ copies[a:s]
                for i in np.flatnonzero(near.any(axis=1)):
                    others = np.flatnonzero(near[i])
                    for t in np.unique(tree[others]):
                        if t != tree[p + i - a]:
                            us.append(rep[p + i])
                            vs.append(rep[a + others[tree[others] == t][0]])
                            tree[tree == t] = tree[p + i - a]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(rep, np.array(us, np.int64))), pa.array(np.append(np.full(len(rep), -1), np.array(vs, np.int64))), pa.array(np.append(links, np.zeros(len(us), np.int64)))], ["rep", "other", "links"]
        )


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """Group chunks with their unit vectors (rows of different width are padded with zeros; ``_width`` tells them apart)."""
    carry: list = []

    def widened(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for row in range(0, batch.num_rows, 4096):
                part = batch.slice(row, 4096)
                carry.extend(part.column(part.schema.get_field_index("embedding")).to_pylist())
                yield part

    for chunk in buckets.groups(widened(batches), columns, rows=30_000):
        n = len(chunk["key"])
        lists = carry[:n]
        del carry[:n]
        size = np.fromiter(map(len, lists), np.int64, n)
        x = np.zeros((n, size.max(initial=1)))
        for w in np.unique(size):
            at = np.flatnonzero(size == w)
            x[at, :w] = unit(np.array([lists[i] for i in at]))
        yield chunk | {"_width": size}, x


def near_duplicates(embeddings: DataFrame, least: float = 0.98, tables: int = 6, hashes: int = 2, probe: int = 4, seed: int = 2, cap: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Only rows with the same label, not null, link; vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing, nor do those
    of different width. Rows that share a vec_id are different vectors. A row
    without links is its own component; an empty table gives no row. Columns
    other than vec_id, label and embedding are not read, whatever their names.
    """
    label = F.col("label").cast("string")
    # A zero's sign makes no difference to a cosine, nor to equality here.
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("embedding"))
    rows = rows.select("*", *[F.xxhash64("label", "embedding", F.lit(s)).alias(f"h{s}") for s in (0, 1)])
    good = usable(rows.select("vec_id", "label", "embedding")).where(F.col("label").isNotNull())
    good = good.select("*", *[F.xxhash64("label", "embedding", F.lit(s)).alias(f"h{s}") for s in (0, 1)])
    # Equal vectors (two 64-bit hashes together) are one: rep is their number in the index.
    classes = good.groupBy("h0", "h1").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = materialize_table(classes.select(F.monotonically_increasing_id().alias("rep"), F.xxhash64("label").alias("label_id"), "h0", "h1", "embedding", "low", "copies"))
    indexed = map_arrow(classes.select("rep", "label_id", "embedding"), lambda b: _indexed(b, tables, hashes, probe, seed), "key long, kind int, rep long, label_id long, s0 long, s1 long")
    indexed = materialize_table(indexed)
    n = indexed.groupBy("key").agg(F.sum((F.col("kind") == 0).cast("long")).alias("s"), F.sum((F.col("kind") == 1).cast("long")).alias("p"))
    hot = n.where((F.col("s") > cap) | ((F.col("s") > 0) & (F.col("p") > 4 * cap))).select("key", F.ceil(F.greatest("s", F.lit(1)) / cap).alias("gs"), F.ceil(F.col("p") / (4 * cap)).alias("gp"))
    dealt = buckets.dealt(buckets.split_hot(indexed, hot, "rep"))
    candidates = map_arrow(dealt, lambda b: _candidates(b, sketch_limit(least)), "u long, v long")
    near = materialize_table(connected_components(candidates))
    members = near.join(classes, near.node == classes.rep).select(F.col("root").alias("key"), F.lit(0).alias("kind"), "rep", "label_id", "copies", "embedding")
    sizes = near.groupBy(F.col("root").alias("key")).agg(F.count("*").alias("s")).where(F.col("s") > cap)
    split = buckets.split_hot(members, sizes.select("key", F.ceil(F.col("s") / cap).alias("gs"), F.lit(0).cast("long").alias("gp")), "rep")
    compared = materialize_table(map_arrow(buckets.dealt(split), lambda b: _compared(b, least), "rep long, other long, links long"))
    roots = connected_components(compared.where("other >= 0").select(F.col("rep").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "rep")
    counted = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("rep", "h0", "h1", "low", "copies").join(roots, "rep", "left").join(counted, "rep", "left")
    known = materialize_table(known.select("h0", "h1", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    lowest = known.groupBy("root").agg(F.min("low").alias("component"))
    known = materialize_table(spread_join(known, lowest, ["root"], ["h0"]).select("h0", "h1", "n_links", "component"))
    whole = spread_join(materialize_table(rows.select("vec_id", "h0", "h1")), known, ["h0", "h1"], ["vec_id"], "left")
    component = F.coalesce("component", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
