"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to ``longest``-grams of the whole text's letters (lower-cased,
other characters are word edges), hashed; their counts are damped, weighted by
inverse document frequency over all training documents and scaled to unit
length. The model is trained with follow-the-regularised-leader (proximal
updates with per-coordinate rates, elastic-net penalties) on a bounded sample of
labelled documents, then its temperature is calibrated on another part of them.

Spark counts document frequencies over every training text and reduces the
sample's texts to sparse counts, in pieces of bounded size. Those stream through
one task in seeded order, as the updates are sequential: it holds the updates'
state (``dim`` x languages) and one document at a time. The driver gets the
weights that are not zero; most are, as the l1 penalty is chosen for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, joined, map_arrow, materialize_table, pieces, slices_by_bytes

UNKNOWN = "und"
_CHUNK = 1 << 18
_SALT = np.array([0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)


def counts(text: str | None, dim: int, longest: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature ids, counts) of a text's character n-grams, or None if it has no letter; bounded memory for any length."""
    text = (text or "").lower()
    total = None
    letters = False
    for at in range(0, len(text), _CHUNK):
        # Neighbouring chunks share longest - 1 characters, so that n-grams across the cut count once.
        part = text[max(0, at - longest + 1) : at + _CHUNK]
        code = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        letter = _letter(code, part)
        letters = letters or bool(letter.any())
        c = np.where(letter, code, 32).astype(np.uint64)
        if at == 0:
            c = np.concatenate((np.array([32], np.uint64), c))
        fresh = longest - 1 if at else 0
        ids = []
        h = np.zeros(len(c), np.uint64)
        for n in range(1, longest + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * np.uint64(0x01000193)) ^ c[n - 1 :]
            keep = h[max(0, fresh - n + 1) :] if at else h
            x = (keep + _SALT[n]) * np.uint64(0x9E3779B97F4A7C15)
            ids.append(x >> np.uint64(64 - dim.bit_length() + 1))
        found = np.bincount(np.concatenate(ids).astype(np.int64), minlength=dim)
        total = found if total is None else total + found
    if not letters:
        return None
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.int32)


_LETTER_TABLE: list[np.ndarray] = []


def _letter(code: np.ndarray, part: str) -> np.ndarray:
    if not _LETTER_TABLE:
        _LETTER_TABLE.append(np.array([chr(i).isalpha() for i in range(0x3000)]))
    table = _LETTER_TABLE[0]
    high = code >= len(table)
    out = table[np.where(high, 0, code)]
    if high.any():
        at = np.flatnonzero(high)
        out[at] = [chr(int(x)).isalpha() for x in code[at]]
    return out


def vector(ids: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[ids]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Model:
    """Sparse weights by feature: those of feature i are at first[i] .. first[i + 1], each with its language's number."""

    languages: list[str]
    idf: np.ndarray
    first: np.ndarray
    of: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    dim: int
    longest: int

    def logits(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.bias + products(self.first, self.of, self.weight, ids, x, len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text, self.dim, self.longest) if text else None
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found[0], vector(*found, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def products(first: np.ndarray, of: np.ndarray, weight: np.ndarray, ids: np.ndarray, x: np.ndarray, classes: int) -> np.ndarray:
    n = first[ids + 1] - first[ids]
    at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.bincount(of[at], weights=weight[at] * np.repeat(x, n), minlength=classes)


def by_feature(feature: np.ndarray, dim: int) -> np.ndarray:
    """Where each feature's weights begin, for weights sorted by feature."""
    return np.searchsorted(feature, np.arange(dim + 1))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates and elastic net; a row touches its own coordinates only.
    The last coordinate is the bias, whose input is 1."""

    def __init__(self, dim: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))
        self.alpha, self.beta, self.l1, self.l2, self.dim = alpha, beta, l1, l2, dim

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        # The bias isn't penalised.
        l1 = np.where(at == self.dim, 0.0, self.l1)[:, None]
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, ids: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(ids, self.dim), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        sq = self.n[at]
        self.z[at] += g - (np.sqrt(sq + g * g) - np.sqrt(sq)) / self.alpha * w
        self.n[at] = sq + g * g


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss, by golden section over its logarithm.

    Labels are smoothed to (n + 1) / (n + 2), as in Platt scaling, so that a
    sample without an error doesn't make every score 1.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    sure = (len(y) + 1) / (len(y) + 2)
    goal = np.full(logits.shape, (1 - sure) / (logits.shape[1] - 1))
    goal[np.arange(len(y)), y] = sure

    def loss(t: float) -> float:
        return -float((goal * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean())

    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(
    docs: DataFrame, dim: int = 1 << 15, longest: int = 3, sample: int = 4000, calibration: int = 1000,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1e-4, epochs: int = 2, seed: int = 5,
) -> Model:
    """Learn from text and lang of the rows whose crc32(doc_id) mod 4 is not 2.

    Document frequencies cover all of these rows' texts. ``sample`` +
    ``calibration`` labelled texts (the bound of what is fitted; those of smallest
    hash of id and text) train the weights and the temperature. Rows that share an
    id, or have none, are told apart by their texts; equal rows count once, and of
    several langs of theirs the smallest. Rows with a null text or lang, or without
    a letter, teach nothing; without labels the model has no language and predicts
    ``und``.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dim, np.int64), 0
        for part in slices_by_bytes(batches, "text"):
            for t in part.column("text").to_pylist():
                found = counts(t, dim, longest)
                if found is not None:
                    df[found[0]] += 1
                    n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "n"])

    df = map_arrow(rows.select("text"), frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = df.toPandas()  # at most dim + 1 rows
    n_docs = int(found.n[found.feature < 0].sum())
    idf = np.full(dim, np.log(1.0 + n_docs) + 1)
    kept = found[found.feature >= 0]
    idf[kept.feature.to_numpy()] = np.log((1 + n_docs) / (1 + kept.n.to_numpy())) + 1

    chosen = rows.where(F.col("lang").isNotNull()).withColumn("h", F.xxhash64("id", "text", F.lit(seed)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_by_bytes(batches, "text"):
            found = [counts(t, dim, longest) for t in part.column("text").to_pylist()]
            yield from pieces(part.select(["h", "lang"]), found, [pa.int32(), pa.int32()], ["ids", "ns"])

    # The hash that bounds the sample; only the sample's texts are then reduced.
    limit = sample + calibration
    top = chosen.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h"), F.count("*")).first()
    nothing = Model([], idf, np.zeros(dim + 1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 1.0, dim, longest)
    if not top[1]:
        return nothing
    taken = chosen.where(F.col("h") <= top[0]).select("h", "lang", "text")
    # Equal rows give equal pieces, of which one stays.
    taken = map_arrow(taken, sparse, "h long, lang string, part int, ids array<int>, ns array<int>").groupBy("h", "part")
    taken = materialize_table(taken.agg(F.min("lang").alias("lang"), F.first("ids").alias("ids"), F.first("ns").alias("ns")))
    languages = [r[0] for r in taken.select("lang").distinct().orderBy("lang").limit(limit).collect()]
    if not languages:
        return nothing
    # One part in five calibrates; the others come once an epoch, in an order seeded by it.
    held = F.pmod(F.xxhash64("h", F.lit("calibrate")), F.lit(limit)) < calibration
    turns = F.when(held, F.array(F.lit(epochs))).otherwise(F.sequence(F.lit(0), F.lit(epochs - 1)))
    stream = taken.withColumn("turn", F.explode(turns)).withColumn("place", F.xxhash64("h", "turn", F.lit(seed)))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(dim, len(languages), alpha, beta, l1, l2)
        logits, truth, dense = [], [], None
        for row in joined(batches, ["turn", "h"], ["ids", "ns"]):
            ids, y = row["ids"], languages.index(row["lang"])
            x = vector(ids, row["ns"], idf)
            if row["turn"] < epochs:
                model.step(ids, x, y)
                continue
            dense = model.weights(np.arange(dim + 1)) if dense is None else dense
            logits.append(x @ dense[ids] + dense[dim])
            truth.append(y)
        dense = model.weights(np.arange(dim + 1)) if dense is None else dense
        at, of = np.nonzero(dense[:dim])
        classes = np.arange(len(languages))
        t = calibrate(np.array(logits).reshape(len(truth), len(languages)), np.array(truth, int))
        columns = [np.concatenate((at, np.full(len(classes), dim), [dim + 1])), np.concatenate((of, classes, [0])), np.concatenate((dense[at, of], dense[dim], [t]))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "of", "weight"])

    # One task: at most ``sample`` + ``calibration`` documents, each in pieces, pass by it in order.
    fit = map_arrow(stream.repartition(1).sortWithinPartitions("turn", "place", "h", "part"), fitted, "feature long, of long, weight double")
    got = fit.toPandas().sort_values(["feature", "of"])  # at most (dim + 1) x languages + 1 rows
    w = got[got.feature < dim]
    return Model(languages, idf, by_feature(w.feature.to_numpy(), dim), w.of.to_numpy(), w.weight.to_numpy(), got.weight[got.feature == dim].to_numpy(), float(got.weight.iloc[-1]), dim, longest)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document; ``und`` and 0 for texts that are null or have no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_by_bytes(batches, "text"):
            found = [shared.value.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, lang_pred string, score double")


def language(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the part of ``docs`` that may be learnt from, applied to all.

    Repeated rows give repeated rows; null ids are not held out; an empty table gives no row; very long texts are
    read whole; of languages with equal scores the first in order is predicted; further columns are left out.
    """
    found = identify(docs, train(docs, **options))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents whose language is known with a score of ``least`` at least; all columns and the text as it was.

    Null texts and texts without a letter go; null ids stay; repeated rows stay or go together; an empty table gives no row.
    """
    model = train(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_by_bytes(batches, "text"):
            found = [shared.value.predict(t) for t in part.column("text").to_pylist()]
            yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found]))

    return map_arrow(docs, run, schema)
