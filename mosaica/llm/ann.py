"""Nearest neighbours by collision counting over query-aware projections, radius first.

A block holds up to ``block_rows`` distinct vectors as ``lines`` sorted arrays,
each of one random projection, built once. A query opens a window around its own
projection in every array; virtual rehashing widens the windows, reading only
what is new; vectors that stand in enough windows (the collision threshold) are
verified by their cosine. Windows reach far enough once they cover ``tau`` times
the distance of the k-th best vector known: for a pair at distance s the
difference of projections is normal with deviation s, so such windows catch it
with one and the same probability, and the threshold lies ``slack`` deviations
below the number of windows expected then.

1. Equal vectors are one, with their k + 1 smallest rows. A bounded sample of
   vectors are pivots; a vector's cell is its nearest pivot, cells are cut into
   shells of nearly equal distance from the pivot, and shells above a block's
   size are dealt into several blocks.
2. Each query is searched in its own block, which gives it a radius: the
   distance of its k-th best there.
3. It then visits only the blocks whose shell a ball of that radius meets (the
   triangle inequality, so none that holds a nearer vector is left out), and
   opens windows just to that radius.

Scores are sums in a fixed order, column by column, so equal vectors have equal
scores wherever they stand and ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, materialize_table, spread_join
from .embedding_dedup import by_width, dots, unit, unit_rows, usable

SHELLS = 64


class Block:
    """Sorted projections of unit vectors (n x d) with their numbers and smallest vec_ids."""

    def __init__(self, x: np.ndarray, v: np.ndarray, low: np.ndarray, lines: int, seed: int):
        self.v, self.low, self.lines = v, low, lines
        self.xt = np.ascontiguousarray(x.T)
        self.axes = np.random.default_rng(seed).normal(size=(x.shape[1], lines))
        p = np.ascontiguousarray((x @ self.axes).T)
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(p, self.order, 1)
        self.verified = self.counted = 0

    def search(self, q: np.ndarray, radius: float, k: int, tau: float, slack: float, first: float, growth: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k best found for a unit vector, best first, ties to the smaller vec_id; with a finite
        ``radius`` only what lies within it matters."""
        n, lines = len(self.v), self.lines
        hit = 2 * NormalDist().cdf(tau) - 1
        need = max(1, int(np.ceil(lines * hit - slack * np.sqrt(lines * hit * (1 - hit)))))
        centre = q @ self.axes
        count = np.zeros(n, np.int64)
        lo = np.array([np.searchsorted(self.value[a], centre[a]) for a in range(lines)])
        hi = lo.copy()
        seen = np.zeros(n, bool)
        rows, score = np.empty(0, np.int64), np.empty(0)
        half = tau * radius if np.isfinite(radius) else tau * first
        while True:
            low = np.array([np.searchsorted(self.value[a], centre[a] - half, "left") for a in range(lines)])
            high = np.array([np.searchsorted(self.value[a], centre[a] + half, "right") for a in range(lines)])
            outside = int((low + n - high).sum())
            fresh = int((lo - low + high - hi).sum())
            # What is new is counted in, or what lies outside is counted out, whichever is less.
            if fresh <= outside:
                part = [self.order[a, low[a] : lo[a]] for a in range(lines)] + [self.order[a, hi[a] : high[a]] for a in range(lines)]
                count += np.bincount(np.concatenate(part), minlength=n)
            else:
                part = [self.order[a, : low[a]] for a in range(lines)] + [self.order[a, high[a] :] for a in range(lines)]
                count = lines - np.bincount(np.concatenate(part), minlength=n)
            self.counted += min(fresh, outside)
            lo, hi = low, high
            done = not outside
            new = np.flatnonzero(((count >= need) | done) & ~seen)
            seen[new] = True
            self.verified += len(new)
            rows = np.concatenate((rows, new))
            score = np.concatenate((score, dots(self.xt[:, new], q[:, None])))
            if len(rows) > k:
                # Places k - 1 and on: everything that ties with the k-th is kept until ids decide.
                keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                rows, score = rows[keep], score[keep]
            # Distance of unit vectors: sqrt(2 - 2 cos).
            reach = min(radius, np.sqrt(max(0.0, 2 - 2 * score.min())) if len(rows) >= k else np.inf)
            if done or half >= tau * reach:
                best = np.lexsort((self.low[rows], -score))[:k]
                return rows[best], score[best]
            half = min(half * growth, tau * reach)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Batches sorted by (key, cell, kind), cut where one of them changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "cell", "kind"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.append(edge, len(key)), strict=True):
            yield (int(key[a]), int(cell[a])), int(kind[a]), batch.slice(a, b - a)


def _searched(batches: Iterator[pa.RecordBatch], k: int, lines: int, tau: float, slack: float, first: float, growth: float, seed: int) -> Iterator[pa.RecordBatch]:
    """A block's rows come first and are indexed, then its queries pass by; only one block is held at a time."""
    current, held, block = None, [], None
    for key, kind, part in _parts(batches):
        if key != current:
            current, held, block = key, [], None
        if kind == 0:
            held.append(part)
            continue
        if not held and block is None:
            continue
        if block is None:
            number = lambda c: np.concatenate([h.column(h.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for h in held])
            block, held = Block(np.concatenate([unit_rows(h) for h in held]), number("v"), number("low"), lines, seed), []
        x = unit_rows(part)
        radius, asked = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("radius", "v"))
        for a in range(0, len(x), 1024):
            found = [block.search(x[i], radius[i], k, tau, slack, first, growth) for i in range(a, min(len(x), a + 1024))]
            n = [len(f[0]) for f in found]
            at = np.concatenate([f[0] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[a : a + 1024], n)), pa.array(block.v[at]), pa.array(block.low[at]), pa.array(np.concatenate([f[1] for f in found]))], ["q", "v", "low", "score"])


class Pivots:
    """Sampled unit vectors by width, with the shells around them: cuts, and the smallest and largest distance of each."""

    def __init__(self, rows: list[list[float]]):
        self.x: dict[int, np.ndarray] = {}
        self.number: dict[int, np.ndarray] = {}
        for w in sorted({len(r) for r in rows}):
            at = [i for i, r in enumerate(rows) if len(r) == w]
            self.x[w], self.number[w] = unit(np.array([rows[i] for i in at])), np.array(at)
        self.cuts: dict[int, np.ndarray] = {}
        self.shells: dict[int, dict[int, tuple[float, float, int, int]]] = {}  # cell -> shell -> (least, most, first block, blocks)
        self.loose = 1  # blocks of a width without a pivot

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To the pivots of that width, in one way for rows and queries."""
        return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ self.x[x.shape[1]].T)))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.shape[1] not in self.x:
            return np.full(len(x), -x.shape[1]), np.zeros(len(x))
        d = self.distances(x)
        near = d.argmin(axis=1)
        return self.number[x.shape[1]][near], d[np.arange(len(x)), near]

    def visits(self, x: np.ndarray, radius: float, own: int) -> list[int]:
        """Blocks other than its own that a unit vector's ball may meet."""
        w = len(x)
        if w not in self.x:
            return [b for b in range(-w * self.loose, -w * self.loose + self.loose) if b != own]
        out = []
        for cell, d in zip(self.number[w], self.distances(x[None])[0], strict=True):
            for least, most, start, blocks in self.shells.get(int(cell), {}).values():
                if least - radius - 1e-6 <= d <= most + radius + 1e-6:
                    out += [b for b in range(start, start + blocks) if b != own]
        return out


def _with(part: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in columns.values())], [*part.schema.names, *columns])


def nearest(
    embeddings: DataFrame, is_query: Column | None = None, k: int = 5, lines: int = 128, tau: float = 1.3, slack: float = 1.9, first: float = 0.3, growth: float = 1.5,
    block_rows: int = 8192, max_pivots: int = 1024, block_queries: int = 65_536, seed: int = 3,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, by largest cosine, ties to the smaller vec_id.

    Queries are the rows where ``is_query`` holds (vec_id divisible by 50 unless
    given); candidates are all rows but the query's own. Vectors that are null,
    empty, zero or hold null or non-finite components take no part, and vectors
    of different width are not compared. A repeated row is a candidate for its
    copy; fewer than k candidates are all returned; an empty table gives no row.
    Only the columns vec_id and embedding are read. What the driver and tasks
    share are ``max_pivots`` vectors and at most 64 shells of each.
    """
    rows = materialize_table(usable(embeddings).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"))
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    # The k + 1 smallest rows of each distinct vector; the limit acts before the shuffle, so a vector of many copies is as light as any.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id", "row"))
    few = rows.withColumn("_r", place).where(F.col("_r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    distinct = materialize_table(few.select(F.monotonically_increasing_id().alias("v"), "embedding", "ids", F.col("ids")[0]["vec_id"].alias("low")))
    asking = materialize_table(rows.where(is_query).select("row", "vec_id", "embedding", F.xxhash64("embedding").alias("h")))
    asking = spread_join(asking, distinct.select(F.xxhash64("embedding").alias("h"), F.col("embedding").alias("_e"), "v"), ["h"], ["row"]).where(F.col("embedding") == F.col("_e"))
    asking = materialize_table(asking.select("row", "vec_id", "v"))

    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("v", F.lit(seed)), "v").select("embedding").limit(max(1, min(max_pivots, 2 * total // block_rows))).collect()
    pivots = Pivots([r[0] for r in sample])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in by_width(batches):
            cell, distance = pivots.home(x)
            yield _with(part, cell=cell.astype(np.int64), distance=distance)

    held = materialize_table(map_arrow(distinct.select("v", "low", "embedding"), placed, "v long, low long, embedding array<double>, cell long, distance double"))
    inner = [i / SHELLS for i in range(1, SHELLS)]
    cells = held.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("distance", inner, 2000).alias("cuts")).collect()  # a row per pivot
    for r in cells:
        shells = max(1, min(SHELLS, r["n"] // block_rows))
        pivots.cuts[r["cell"]] = np.array([r["cuts"][SHELLS * i // shells - 1] for i in range(1, shells)])
    pivots.loose = max(1, -(-held.where("cell < 0").count() // block_rows))

    numbers = lambda part, *names: (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names)

    def shelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cell, distance = numbers(part, "cell", "distance")
            shell = np.zeros(len(cell), np.int64)
            for c in np.unique(cell[cell >= 0]):
                shell[cell == c] = np.searchsorted(pivots.cuts[c], distance[cell == c])
            yield _with(part, shell=shell)

    shells = map_arrow(held, shelled, "v long, low long, embedding array<double>, cell long, distance double, shell long")
    start = 0
    for r in shells.where("cell >= 0").groupBy("cell", "shell").agg(F.count("*").alias("n"), F.min("distance").alias("a"), F.max("distance").alias("b")).orderBy("cell", "shell").collect():
        blocks = -(-r["n"] // block_rows)
        pivots.shells.setdefault(r["cell"], {})[r["shell"]] = (r["a"], r["b"], start, blocks)
        start += blocks

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shelled(batches):
            cell, shell, v = numbers(part, "cell", "shell", "v")
            turn = ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            key = cell * pivots.loose + turn % pivots.loose
            for at in np.flatnonzero(cell >= 0):
                _, _, start, blocks = pivots.shells[cell[at]][shell[at]]
                key[at] = start + turn[at] % blocks
            yield _with(part.select(["v", "low", "embedding"]), key=key)

    stored = materialize_table(map_arrow(held, keyed, "v long, low long, embedding array<double>, key long"))
    wanted = asking.select("v").distinct()
    stored_ = stored.select("key", F.lit(0).alias("kind"), "v", "low", "embedding", F.lit(float("inf")).alias("radius"))
    queries = materialize_table(stored.join(wanted, "v", "left_semi").select("key", F.lit(1).alias("kind"), "v", "low", "embedding"))

    def searched(asked: DataFrame) -> DataFrame:
        # A block that very many queries visit is repeated for parts of them.
        hot, n = broadcast_if_small(asked.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_queries).select("key", F.ceil(F.col("n") / block_queries).alias("parts")))
        if n:
            parts = F.coalesce("parts", F.lit(1)).cast("long")
            base = stored_.join(hot, "key", "left").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
            asked = asked.join(hot, "key", "left").withColumn("cell", F.pmod(F.xxhash64("v"), parts)).drop("parts")
        else:
            base, asked = stored_.withColumn("cell", F.lit(0).cast("long")), asked.withColumn("cell", F.lit(0).cast("long"))
        # Blocks that nobody visits aren't moved.
        base = base.join(asked.select("key").distinct(), "key", "left_semi")
        work = base.unionByName(asked).repartition("key", "cell").sortWithinPartitions("key", "cell", "kind")
        return map_arrow(work, lambda b: _searched(b, k + 1, lines, tau, slack, first, growth, seed), "q long, v long, low long, score double")

    near = materialize_table(searched(queries.withColumn("radius", F.lit(float("inf")))))
    # k + 1, as the vector itself is among them.
    known = near.groupBy("q").agg(F.when(F.count("*") > k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).otherwise(float("inf")).alias("radius"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in by_width(batches):
            key, radius = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "radius"))
            for a in range(0, len(x), 64):
                found = [pivots.visits(x[i], radius[i], key[i]) for i in range(a, min(len(x), a + 64))]
                at = pa.array(np.repeat(np.arange(a, a + len(found)), [len(f) for f in found]))
                yield _with(part.select(["kind", "v", "low", "embedding", "radius"]).take(at), key=np.concatenate([np.array(f, np.int64) for f in found]))

    second = queries.join(known.withColumnRenamed("q", "v"), "v")
    second = materialize_table(map_arrow(second, visits, "kind int, v long, low long, embedding array<double>, radius double, key long"))
    best = near.unionByName(searched(second))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low"))).where(F.col("_r") <= k + 1)
    # Vectors to rows: a query vector's list has k + 1 rows at most, and each query row leaves itself out.
    best = spread_join(materialize_table(best.select("q", "v", "score")), distinct.select("v", "ids"), ["v"], ["q"])
    each = best.select("q", "score", F.inline("ids"))
    each = each.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("_r") <= k + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "row"))).alias("list"))
    out = spread_join(asking.select(F.col("v").alias("q"), "row", F.col("vec_id").alias("query_id")), lists, ["q"], ["row"])
    out = out.select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["row"] != F.col("row")), 1, k)).alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.col("one.less"))).alias("score"))
