"""Tiled cross products of allele counts that travel as bits.

An entity's count (0, 1, 2 or missing) at a feature takes two bits and a third that
says whether there is one. Words of 64 entities are summed map-side from the panel's
rows, so a panel stored by variants is never shuffled row by row, and it is words
that are copied to the cells of a tile's row and column, not numbers. A task turns
them into numbers with a shift and a scale for each feature or each entity (centring,
scaling, prior weights; a missing count is worth 0, as an imputed mean is) and sums
their products through BLAS, a block of features at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ensure_on_workers
from .segments import RANGE, packed_bits

TILE = 512
BLOCK = 1024


def numbers(present: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray, scale: np.ndarray, out: np.ndarray) -> None:
    """Rows of words to rows of numbers: (count - shift) * scale, 0 where there is no count (both bits set) or no row."""
    p, a, b = (np.unpackbits(w.view(np.uint8), axis=1, bitorder="little") for w in (present & ~(low & high), low, high))
    np.add(a, b << 1, out=a)
    np.subtract(a, shift, out=out)
    out *= scale
    if not p.all():
        out *= p


class Product:
    """The sums of products of one cell: two tiles of entities, or one with itself. A block of features is kept as words until it is full."""

    def __init__(self, key: tuple[int, ...], names: int, tile: int, each: bool):
        self.key, self.tile, self.same, self.each = key, tile, key[1] == key[2], each
        self.sum = np.zeros((names, names, tile, tile))
        self.x = np.zeros((names, BLOCK, tile))
        self.y = self.x if self.same else np.zeros((names, BLOCK, tile))
        self.words = np.zeros((1 if self.same else 2, 1 + 2 * names, BLOCK, tile // RANGE), "<i8")
        self.params = np.zeros((len(self.words), 2 * names, BLOCK, tile // RANGE) if each else 0)
        self.has = np.zeros((2, tile // RANGE), "<i8")
        self.own = np.tile(np.array([0.0, 1.0])[None, :, None, None], (2, 1, names, tile))  # side, shift and scale, name, entity
        self.n, self.feature = 0, None

    def fold(self) -> None:
        if not self.n:
            return
        for side, x in ((0, self.x), (1, self.y))[: len(self.words)]:
            w = self.words[side, :, : self.n]
            self.has[side] |= np.bitwise_or.reduce(w[0], axis=0)
            for p in range(len(x)):
                shift, scale = (np.repeat(self.params[side, 2 * p + k, : self.n], RANGE, axis=1) for k in (0, 1)) if self.each else (self.own[side, 0, p], self.own[side, 1, p])
                numbers(w[0], w[1 + 2 * p], w[2 + 2 * p], shift, scale, x[p, : self.n])
        for p in range(len(self.x)):
            for q in range(len(self.x)):
                if self.same and q < p:
                    self.sum[p, q] = self.sum[q, p].T
                else:
                    self.sum[p, q] += self.x[p, : self.n].T @ self.y[q, : self.n]
        self.words[:, :, : self.n] = 0
        self.n = 0

    def add(self, feature: np.ndarray, word: np.ndarray, bits: list[np.ndarray], params: list[np.ndarray] | None) -> None:
        """Rows in order of feature and word; ``params`` are a row's shifts and scales by name, or None where entities have their
        own. Rows of one feature and word, of different entities, are one row."""
        first = np.flatnonzero(np.concatenate(([True], (feature[1:] != feature[:-1]) | (word[1:] != word[:-1]))))
        if len(first) < len(feature):
            feature, word, bits = feature[first], word[first], [np.bitwise_or.reduceat(w, first) for w in bits]
            params = None if params is None else [p[first] for p in params]
        fresh = np.concatenate(([feature[0] != self.feature], feature[1:] != feature[:-1]))
        order = self.n - 1 + np.cumsum(fresh)
        a = 0
        while a < len(feature):
            if order[a] >= BLOCK:
                self.fold()
                order = order - order[a]
            b = int(np.searchsorted(order, BLOCK))
            self._put(order[a:b], word[a:b], [w[a:b] for w in bits], None if params is None else [p[a:b] for p in params])
            self.n = int(order[b - 1]) + 1
            a = b
        self.feature = feature[-1]

    def _put(self, n: np.ndarray, word: np.ndarray, bits: list[np.ndarray], params: list[np.ndarray] | None) -> None:
        words = self.tile // RANGE
        for side in range(len(self.words)):
            mine = word // words == self.key[1 + side]
            at = word[mine] % words
            for k, w in enumerate(bits):
                self.words[side, k, n[mine], at] |= w[mine]
            for k, p in enumerate(params or []):
                self.params[side, k, n[mine], at] = p[mine]

    def rows(self, within: int | None) -> Iterator[tuple[np.ndarray, ...]]:
        self.fold()
        _, ti, tj, _ = self.key
        a, b = (np.flatnonzero(np.unpackbits(self.has[side].view(np.uint8), bitorder="little")) for side in (0, 0 if self.same else 1))
        for part in np.array_split(a, max(1, len(a) // 64)):
            i, j = np.meshgrid(part, b, indexing="ij")
            keep = (i >= j) if self.same else np.ones(i.shape, bool)
            if within is not None:
                keep &= i + ti * self.tile - j - tj * self.tile < within
            i, j = i[keep], j[keep]
            yield i + ti * self.tile, j + tj * self.tile, *(self.sum[p, q][i, j] for p in range(len(self.x)) for q in range(len(self.x)))


def packed_counts(counts: DataFrame, names: list[str]) -> DataFrame:
    """(block, feature, entity, <names>: 0, 1, 2 or null) -> block, feature, word, present and two planes of bits for each name."""
    code = {n: F.coalesce(F.col(n).cast("int"), F.lit(3)) for n in names}
    planes = {f"{n}_{k}": code[n].bitwiseAND(F.lit(1 << k)) != 0 for n in names for k in (0, 1)}
    return packed_bits(counts, ["block", "feature"], {"present": F.lit(True)} | planes, where="entity").withColumnRenamed("range", "word")


def coded_products(counts: DataFrame, names: list[str], by_feature: DataFrame | None = None, by_entity: DataFrame | None = None, tile: int = TILE, within: int | None = None, tasks: int | None = None) -> DataFrame:
    """(block, feature, entity, <names>: 0, 1, 2 or null) -> block, i, j (i >= j), and <a>_<b> = sum over features of a_i * b_j,
    a = (count - shift) * scale, 0 for null and for rows that aren't there.

    Shifts and scales come by feature (feature, <name>_shift, <name>_scale; features without are left out) or by entity
    (block, entity, the same). Entities are compared inside their ``block`` only, and with ``within`` only those fewer places
    apart. A block of few cells is dealt over about ``tasks`` tasks by features.
    """
    tile = RANGE * -(-(tile if within is None else min(tile, max(RANGE, within))) // RANGE)
    tiles = counts.select("block", F.floor(F.col("entity") / tile).alias("tile"))
    return word_products(packed_counts(counts, names), tiles, names, by_feature, by_entity, tile, within, tasks)


def word_products(words: DataFrame, tiles: DataFrame, names: list[str], by_feature: DataFrame | None = None, by_entity: DataFrame | None = None, tile: int = TILE, within: int | None = None, tasks: int | None = None, least: int | None = None) -> DataFrame:
    """The products of counts that are packed already (``packed_counts``), over the tiles (block, tile; repeats allowed) that
    hold entities. With ``least`` only cells whose larger tile is at least that are made."""
    spark = words.sparkSession
    ensure_on_workers(spark)
    tasks = tasks or min(64, max(8, spark.sparkContext.defaultParallelism))
    feature_type = words.schema["feature"].dataType
    planes = [f"{n}_{k}" for n in names for k in (0, 1)]
    given = [f"{n}_{x}" for n in names for x in ("shift", "scale")]
    if by_feature is not None:
        words = words.join(by_feature.select("feature", *[F.col(c).cast("double").alias(c) for c in given]), "feature")
    else:
        words = words.select("*", *[F.lit(None).cast("double").alias(c) for c in given])
    words = words.select("block", "feature", "word", "present", *planes, *given, F.lit(None).cast("array<double>").alias("own"))
    tiles = tiles.distinct().groupBy("block").agg(F.sort_array(F.collect_set("tile")).alias("_t"))
    size = F.size("_t")
    cells = size * (size + 1) / 2 if within is None else size * (2 if within > 1 else 1)
    tiles = tiles.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.lit(tasks) / cells)).cast("int"))
    part = F.array(F.pmod(F.xxhash64("feature"), F.col("_parts")).cast("int"))
    if by_entity is not None:
        # A word's entities' shifts and scales in one row, ahead of all features, for every part.
        at = F.col("entity").cast("long")
        of = by_entity.groupBy(F.col("block"), F.floor(at / RANGE).alias("word")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod(at, F.lit(RANGE)).cast("int"), F.array(*[F.col(c).cast("double") for c in given])))).alias("_m"))
        plain = F.array(*[F.lit(float(k % 2)) for k in range(len(given))])
        own = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(RANGE - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), plain)))
        zero = F.lit(0).cast("long")
        words = words.unionByName(of.select("block", F.lit(None).cast(feature_type).alias("feature"), "word", zero.alias("present"), *[zero.alias(p) for p in planes], *[F.lit(None).cast("double").alias(c) for c in given], own.alias("own")))
        part = F.when(F.col("own").isNotNull(), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(part)
    # A tile goes to the cells it is the larger or the smaller half of.
    mine = F.floor(F.col("word") / (tile // RANGE))
    reach = None if within is None else -(-(within - 1) // tile)
    near = F.col("_t") if within is None else F.filter("_t", lambda o: F.abs(o - F.col("_mine")) <= reach)
    if least is not None:
        near = F.filter(near, lambda o: F.greatest(o, F.col("_mine")) >= least)
    rows = words.withColumn("_mine", mine).join(tiles, "block").withColumn("_o", F.explode(near)).withColumn("part", F.explode(part))
    rows = rows.select("block", F.greatest("_mine", "_o").alias("ti"), F.least("_mine", "_o").alias("tj"), "part", F.col("feature").cast("long").alias("feature"), "word", "present", *planes, *given, "own")
    rows = rows.repartition("block", "ti", "tj", "part").sortWithinPartitions("block", "ti", "tj", "part", F.asc_nulls_first("feature"), "word")
    outs = [f"{a}_{b}" for a in names for b in names]
    m, each = len(names), by_feature is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: Product | None = None

        def out() -> Iterator[pa.RecordBatch]:
            for i, j, *sums in cell.rows(within) if cell else []:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), cell.key[0])), pa.array(i), pa.array(j), *map(pa.array, sums)], ["block", "i", "j", *outs])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            feature, word = batch.column(4), batch.column(5).to_numpy()
            own = feature.is_null().to_numpy(zero_copy_only=False)
            feature = feature.fill_null(0).to_numpy()
            bits = [batch.column(6 + k).to_numpy() for k in range(1 + 2 * m)]
            params = [batch.column(7 + 2 * m + k).to_numpy() for k in range(2 * m)] if each else None
            cut = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (own[1:] != own[:-1])) + 1, [batch.num_rows]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                key = tuple(keys[:, a].tolist())
                if cell is None or cell.key != key:
                    yield from out()
                    cell = Product(key, m, tile, each)
                if own[a]:
                    for k in range(a, b):
                        values = np.array(batch.column(7 + 4 * m)[k].values).reshape(RANGE, m, 2)
                        w, at = divmod(int(word[k]), tile // RANGE)
                        for side in (0, 1):
                            if w == key[1 + side]:
                                cell.own[side, :, :, at * RANGE : (at + 1) * RANGE] = values.transpose(2, 1, 0)
                else:
                    cell.add(feature[a:b], word[a:b], [w[a:b] for w in bits], None if params is None else [p[a:b] for p in params])
        yield from out()

    partial = rows.mapInArrow(run, "block long, i long, j long, " + ", ".join(f"{o} double" for o in outs))
    return partial.groupBy("block", "i", "j").agg(*[F.sum(o).alias(o) for o in outs])
