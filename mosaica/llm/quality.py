"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)):
the sum-of-squares identity scores all pairwise interactions in time linear in
the number of words. Words are hashed (case kept, since shouting is a sign) with
damped counts scaled to unit length; structure statistics describe characters,
words, lines and repetition; the metadata used is the text's size. Labels,
language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, joined, map_arrow, materialize_table, pieces, slices_by_bytes
from .substring_dedup import word_hashes

#: Structure statistics and metadata, in the order of ``structure``.
STATISTICS = ("chars", "words", "lines", "mean_word", "upper", "digits", "symbols", "non_ascii", "distinct_words", "top_word", "distinct_lines", "repeated_next", "lone_symbols", "line_ends", "short")
_UPPER, _LOWER, _DIGIT, _OTHER, _NL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_OTHER[33:127] = True
_OTHER &= ~(_UPPER | _LOWER | _DIGIT)
_OTHER[[44, 46]] = False  # comma and full stop are prose
_NL[10] = True


def features(text: str | None, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values): hashed words below ``dim``, then one id for each of STATISTICS."""
    data = (text or "").encode()
    b = np.frombuffer(data, np.uint8)
    h, at = word_hashes(data)
    n = len(h)
    bucket, count = np.unique(h >> np.uint64(64 - dim.bit_length() + 1), return_counts=True)
    x = 1 + np.log(count)
    norm = np.sqrt((x * x).sum())
    stats = structure(b, h, at)
    return np.concatenate((bucket.astype(np.int64), dim + np.arange(len(STATISTICS)))), np.concatenate((x / norm if n else x, stats))


def structure(b: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    chars, n = max(len(b), 1), max(len(h), 1)
    by_value = np.bincount(b, minlength=256)
    new_lines = np.flatnonzero(b == 10)
    share = lambda mask: float(by_value[mask].sum()) / chars
    _, words = np.unique(h, return_counts=True)
    line = np.searchsorted(new_lines, at) if len(at) else at
    lines = len(new_lines) + 1
    letters = max(1.0, float(by_value[_UPPER | _LOWER].sum()))
    if len(h):
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        with np.errstate(over="ignore"):
            per_line = np.add.reduceat(h * (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h)))) + 1).astype(np.uint64), first)
        distinct_lines = len(np.unique(per_line)) / len(per_line)
        lone = float((_OTHER[b[at]] & np.append(np.diff(at) == 2, False)).mean())
    else:
        distinct_lines, lone = 1.0, 0.0
    return np.array([
        np.log1p(len(b)) / 10, np.log1p(len(h)) / 10, np.log1p(lines) / 5, min(len(b) / n / 10, 3.0), by_value[_UPPER].sum() / letters,
        share(_DIGIT) * 5, share(_OTHER) * 5, share(slice(128, 256)), len(words) / n, float(words.max(initial=0)) / n,
        distinct_lines, float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0, lone * 3, lines / n, float(len(h) < 5),
    ])


@dataclass
class Model:
    dim: int
    w0: float
    w: np.ndarray
    v: np.ndarray  # (dim + statistics) x rank
    mean: np.ndarray
    scale: np.ndarray

    def prepared(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[-len(STATISTICS) :] = np.clip((x[-len(STATISTICS) :] - self.mean) / self.scale, -4, 4) / 4
        return x

    def score(self, text: str | None) -> float:
        ids, x = features(text, self.dim)
        return float(1 / (1 + np.exp(-np.clip(interactions(self.w0, self.w[ids], self.v[ids], self.prepared(ids, x)), -35, 35))))


def interactions(w0: float, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> float:
    """The machine's sum for one row, linear in its features: the square of sums less the sum of squares."""
    s = x @ v
    return float(w0 + x @ w + 0.5 * (s @ s - ((x * x) @ (v * v)).sum()))


class Machine:
    """Adaptive-gradient descent on log loss, one row at a time; a row touches its own features only."""

    def __init__(self, model: Model, rate: float, l2: float):
        self.m, self.rate, self.l2 = model, rate, l2
        self.gw, self.gv = np.full(model.w.shape, 1e-2), np.full(model.v.shape, 1e-2)

    def step(self, ids: np.ndarray, x: np.ndarray, y: float) -> None:
        m = self.m
        x = m.prepared(ids, x)
        w, v = m.w[ids], m.v[ids]
        s = x @ v
        out = m.w0 + x @ w + 0.5 * (s @ s - ((x * x) @ (v * v)).sum())
        g = 1 / (1 + np.exp(-np.clip(out, -35, 35))) - y
        m.w0 -= 0.01 * g
        dw = g * x + self.l2 * w
        dv = g * (x[:, None] * s[None, :] - (x * x)[:, None] * v) + self.l2 * v
        self.gw[ids] += dw * dw
        self.gv[ids] += dv * dv
        m.w[ids] = w - self.rate * dw / np.sqrt(self.gw[ids])
        m.v[ids] = v - self.rate * dv / np.sqrt(self.gv[ids])


def start(dim: int, rank: int, share: float, mean: np.ndarray, scale: np.ndarray, seed: int) -> Model:
    """The machine before its first row: the labels' share as bias, and small seeded factors."""
    size, share = dim + len(STATISTICS), min(max(share, 0.01), 0.99)
    return Model(dim, float(np.log(share / (1 - share))), np.zeros(size), np.random.default_rng(seed).normal(0, 0.02, (size, rank)), mean, scale)


def train(docs: DataFrame, labels: DataFrame, dim: int = 1 << 16, rank: int = 8, sample: int = 6000, epochs: int = 4, rate: float = 0.1, l2: float = 1e-5, seed: int = 9) -> Model:
    """Learn ``quality`` from labelled rows whose crc32(doc_id) mod 4 is not 2.

    ``sample`` bounds what is fitted: the labelled ids of smallest hash, with one
    text each (of several the one of smallest hash), so rows that share an id don't
    break the bound. Only ids and text hashes are broadcast. Their features, in
    pieces of bounded size, stream through one task in seeded order, as the updates
    are sequential; the driver gets the factors, whose size is fixed. Null labels
    and ids teach nothing, null and empty texts have only statistics; an id with
    several labels has their mean; without labels every score is 0.5.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    marks = marks.groupBy("_id").agg(F.avg("_y").alias("y")).withColumn("h", F.xxhash64("_id", F.lit(seed))).orderBy("h", "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # At most `sample` ids: a size fixed by the parameter, not by the data.
    marks = materialize_table(marks)
    texts = texts.withColumn("t", F.xxhash64("text", F.lit(seed)))
    one = texts.join(F.broadcast(marks.select("_id")), "_id").groupBy("_id").agg(F.min("t").alias("t"))
    rows = texts.join(F.broadcast(marks.join(one, "_id")), ["_id", "t"]).select("h", "y", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_by_bytes(batches, "text"):
            found = [features(t, dim) for t in part.column("text").to_pylist()]
            yield from pieces(part.select(["h", "y"]), found, [pa.int64(), pa.float64()], ["ids", "x"])

    # Equal rows give equal pieces, of which one stays.
    taken = map_arrow(rows, sparse, "h long, y double, part int, ids array<long>, x array<double>").groupBy("h", "y", "part")
    taken = materialize_table(taken.agg(F.first("ids").alias("ids"), F.first("x").alias("x")))
    # The last piece of a row ends with its statistics.
    k = len(STATISTICS)
    last = taken.select("y", "part", F.posexplode("ids").alias("i", "id"), F.col("x")).where(F.col("id") >= dim).select("y", (F.col("id") - dim).alias("s"), F.element_at("x", F.col("i") + 1).alias("x"))
    found = {r["s"]: r for r in last.groupBy("s").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.avg("y").alias("share")).collect()}  # a row for each statistic
    mean = np.array([found[i]["mean"] if found else 0.0 for i in range(k)])
    scale = np.array([max(found[i]["sd"], 1e-3) if found else 1.0 for i in range(k)])
    model = start(dim, rank, found[0]["share"] if found else 0.5, mean, scale, seed)
    if not found:
        return model
    stream = taken.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("place", F.xxhash64("h", "turn", F.lit(seed)))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(start(dim, rank, found[0]["share"], mean, scale, seed), rate, l2)
        for row in joined(batches, ["turn", "h"], ["ids", "x"]):
            machine.step(row["ids"], row["x"], row["y"])
        m = machine.m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(m.w))), pa.array(np.concatenate(([m.w0], m.w))), pa.array([None, *m.v], pa.list_(pa.float64()))], ["feature", "w", "v"])

    got = map_arrow(stream.repartition(1).sortWithinPartitions("turn", "place", "h", "part"), fitted, "feature long, w double, v array<double>").toPandas().sort_values("feature")  # dim + 16 rows
    return Model(dim, float(got.w.iloc[0]), got.w.to_numpy()[1:].copy(), np.stack(got.v.to_numpy()[1:]), mean, scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text, however long; null and empty texts are scored by their statistics.

    Repeated rows and shared or null ids give a row each; columns other than doc_id and text aren't read; ties are equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shared.value.score(t) for t in part.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= threshold).

    Repeated rows give repeated rows; null ids are not held out; an empty table gives no row; very long
    texts are read whole; further columns of either table, whatever their names, are left out.
    """
    found = score(docs, train(docs, labels, **options))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
