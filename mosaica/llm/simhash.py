"""SimHash near-duplicate detection with multi-index hashing.

A fingerprint is cut into segments. By the refined pigeonhole rule, two
fingerprints at distance <= r over m segments (r = m*q + a) agree within q bits
in one of the first a + 1 segments or within q - 1 bits in one of the others,
so small Hamming balls around each segment value find every pair. A probe only
sets bits that are 0 (its partner, where the bit is 1, stays at home): each
pair meets once per segment and the ball has half the rows.

Only distinct fingerprints enter the index (copies share one row), and buckets
yield spanning forests of verified links, so no group is expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buckets
from .common import map_arrow, materialize_table, slices_by_bytes, spread_join
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: majority bits of the XXH64 of its shingles; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() is A-Z only, split() is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, tag, fp) of every document: a hash of its id and text, and its fingerprint. The text is read once, column
    by column, whole (hashes of long texts are added up in parts), and never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_by_bytes(batches, "text"):
            fps = [fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "tag", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag(), F.col("text").cast("string").alias("text")), run, "doc_id long, tag long, fp long")


def _tag() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("tag")


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, ball radius) of each segment."""
    width, wide = divmod(BITS, segments)
    q, a = divmod(radius, segments)
    plan, at = [], 0
    for s in range(segments):
        w = width + (s >= segments - wide)
        r = q if s <= a else q - 1
        if r >= 0:
            plan.append((at, w, r))
        at += w
    return plan


def index_rows(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """(key, kind, fp): each fingerprint under its segment values (kind 0) and under its probes (kind 1)."""
    entries = []
    for s, (at, w, r) in enumerate(segment_plan(radius, segments)):
        mask = (1 << w) - 1
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(mask).cast("long"))
        tag = F.lit(s << 40).cast("long")
        entries.append(F.array(F.struct((tag + value).alias("key"), F.lit(0).alias("kind"))))
        # A ball of radius b: b bits differ. Partners whose differing bits are all 1 probe nothing; a probe sets its
        # zero bits among the b and, for mixed patterns, the side whose lowest differing bit is 0 probes.
        flips = [sum(1 << b for b in bits) for k in range(1, r + 1) for bits in combinations(range(w), k)]
        if flips:
            low = F.array(*[F.lit(x).cast("long") for x in flips])
            probes = F.filter(low, lambda x: value.bitwiseAND(x).bitwiseAND(-x) == 0)
            entries.append(F.transform(probes, lambda x: F.struct((tag + value.bitwiseXOR(x)).alias("key"), F.lit(1).alias("kind"))))
    return fps.select("fp", F.explode(F.concat(*entries)).alias("_e")).select(F.col("_e.key").alias("key"), F.col("_e.kind").alias("kind"), "fp")


def hot_keys(fps: DataFrame, radius: int, segments: int, cap: int) -> DataFrame:
    """(key, gs, gp) of the keys whose stored or probing rows exceed ``cap``; probes are counted from stored counts."""
    rows = index_rows(fps, radius, segments)
    n = rows.groupBy("key").agg(F.sum((F.col("kind") == 0).cast("long")).alias("s"), F.sum((F.col("kind") == 1).cast("long")).alias("p"))
    return n.where((F.col("s") > cap) | (F.col("p") > 16 * cap)).where("s > 0").select("key", F.ceil(F.greatest("s", F.lit(1)) / cap).alias("gs"), F.ceil(F.col("p") / (16 * cap)).alias("gp"))


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for chunk in buckets.groups(batches, ["key", "cell", "kind", "fp"]):
        fp = chunk["fp"].view(np.uint64)
        i, j = buckets.forest(
            chunk,
            lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= radius,
            lambda i, js: np.bitwise_count(fp[js] ^ fp[i]) <= radius,
        )
        ok = fp[i] != fp[j]
        yield pa.RecordBatch.from_arrays([pa.array(chunk["fp"][i[ok]]), pa.array(chunk["fp"][j[ok]])], ["u", "v"])


def segments_for(prints: int, radius: int) -> int:
    """The number of segments that costs least: index rows a fingerprint (each about as much as 200 comparisons) and
    comparisons in the buckets it meets, which fill as fingerprints grow in number. At least one ball has a radius."""
    costs = {}
    for m in range(2, radius + 1):
        plan = segment_plan(radius, m)
        width = min(w for _, w, _ in plan)
        rows = sum(1 + (sum(math.comb(w, b) for b in range(1, r + 1)) + 1) // 2 for _, w, r in plan)
        costs[m] = rows * (200 + prints / 2**width)
    return min(costs, key=costs.get) if costs else 1


def grouped(docs: DataFrame, radius: int = 4, segments: int | None = None, shingle: int = 4, seed: int = 42, cap: int = 4096) -> tuple[DataFrame, DataFrame]:
    """((doc_id, tag, fp) of every row, (fp, root) of every fingerprint): equal roots are one group."""
    prints = materialize_table(fingerprints(docs, shingle, seed))
    fps = materialize_table(prints.select("fp").distinct(), prints.count())
    n = fps.count()
    segments = segments or segments_for(n, radius)
    rows = buckets.split_hot(index_rows(fps, radius, segments), hot_keys(fps, radius, segments, cap), "fp")
    links = map_arrow(buckets.dealt(rows), lambda b: _links(b, radius), "u long, v long")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    return prints, materialize_table(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), n)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links at Hamming distance <= ``radius``, 4 unless given).

    Null and empty texts have fingerprint 0 and link like any other; a null
    doc_id gets a component_id through its fingerprint (null if the whole group
    has none); repeated rows give repeated rows; texts of any length are read
    whole; further columns, whatever their names, are not read; an empty table
    gives no row.
    """
    prints, groups = grouped(docs, **options)
    # Documents and fingerprints of one group may be a third of all: both joins deal them over tasks.
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    n = groups.count()
    members = materialize_table(least.join(groups, "fp"), n)
    smallest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = materialize_table(spread_join(members, smallest, ["root"], ["fp"]).select("fp", "component_id"), n)
    return spread_join(prints, of_fp, ["fp"], ["tag"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, that of smallest id (null ids last, then by text); all columns stay.

    Identical rows (id and text) are one document. A document has to be the only
    one of its group even if ids are null or shared: rows are told apart by id and text.
    """
    prints, groups = grouped(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("tag").alias("tag"))
    least = materialize_table(prints.groupBy("fp").agg(F.min(order).alias("first")).join(groups, "fp"))
    kept = least.groupBy("root").agg(F.min("first").alias("first")).select(F.coalesce("first.doc_id", F.lit(-1)).alias("_id"), F.col("first.tag").alias("_tag"))
    times = prints.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("tag").alias("_tag")).agg((F.count("*") > 1).alias("_many"))
    kept = materialize_table(kept.join(times, ["_id", "_tag"]))
    # The document as one struct: no name of its columns can clash.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), _tag().alias("_tag"), F.struct(*docs.columns).alias("_doc")).join(kept, ["_id", "_tag"])
    once = rows.where("NOT _many").select("_doc.*")
    if kept.where("_many").isEmpty():
        return once
    return once.unionByName(rows.where("_many").dropDuplicates(["_id", "_tag"]).select("_doc.*"))
