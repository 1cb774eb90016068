"""Local-ancestry segments: right-open runs [start, stop) of variant positions with both haplotypes' ancestries.

Dense ancestry is run-length encoded in two levels. A map-side aggregate packs a
person's ancestries of 64 consecutive variants into a few words of bits, so that
what is shuffled is a row for each person and range, not genotypes; a panel that
is stored by variants needs no more memory for that than people x open ranges.
A person's words are then read in order in Arrow batches; what is kept between
batches is the run that is open, so runs that a range's end cut are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ensure_on_workers
from ..functions.ordering import running_sum

#: Variants of a range: the bits of a word.
RANGE = 64


def person():
    """A person's segments in order."""
    return Window.partitionBy("indiv").orderBy("stop")


def bit(place: Column) -> Column:
    """A word with only that bit."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def has(word: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, place.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def packed_bits(rows: DataFrame, keys: list[str], planes: dict[str, Column], where: str = "snp") -> DataFrame:
    """keys, range and a word for each boolean column: bit i is set if it holds at variant 64 * range + i. Summed map-side."""
    at = F.col(where).cast("long")
    word = lambda c: F.bit_or(F.when(c, bit(F.pmod(at, F.lit(RANGE)))).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(*keys, F.floor(at / RANGE).alias("range")).agg(*[word(c).alias(name) for name, c in planes.items()])


def numbered(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """A number for each value of a sorted column, the same for neighbours that are equal; 0 for those equal to ``before``."""
    whole = pa.concat_arrays([pa.array([None if before is None else before.as_py()], column.type), column])
    codes = whole.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return codes[1:] if before is not None else codes[1:] + 1


class Runs:
    """Runs of equal values along a person's variants, batch by batch; the last run stays open until the next batch."""

    def __init__(self) -> None:
        self.open: tuple[pa.Scalar, int, int, int] | None = None  # person, last variant, value, start

    def add(self, column: pa.Array, row: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(persons, starts, stops, values) of the runs that end; ``row`` is an element's place in the column of persons."""
        person = numbered(column, self.open[0] if self.open else None)[row]
        if self.open:
            person, at, value = (np.concatenate(([x], y)) for x, y in ((0, person), (self.open[1], at), (self.open[2], value)))
        shift = len(at) - len(row)
        last = np.concatenate((np.flatnonzero((person[1:] != person[:-1]) | (value[1:] != value[:-1])), [len(at) - 1]))
        begin = np.concatenate(([0], last[:-1] + 1))
        # A person's first run begins at its first variant, another where the one before ends.
        start = np.where((begin > 0) & (person[begin] == person[begin - 1]), at[begin - 1] + 1, at[begin])
        if self.open:
            start[0] = self.open[3]
        ended = last[:-1]
        who = column.take(pa.array(row[ended[ended >= shift] - shift]))
        if len(who) < len(ended):
            who = pa.concat_arrays([pa.array([self.open[0].as_py()], column.type), who])
        out = who, start[:-1], at[ended] + 1, value[ended]
        self.open = column[int(row[-1])], int(at[-1]), int(value[-1]), int(start[-1])
        return out

    def rest(self, kind: pa.DataType) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        person, at, value, start = self.open
        return pa.array([person.as_py()], kind), np.array([start]), np.array([at + 1]), np.array([value])


def _ancestry_runs(geno: DataFrame, n_anc: int | None, each: bool) -> DataFrame:
    """Runs of a person's pair of ancestries (indiv, start, stop, anc0, anc1), or with ``each`` of every haplotype's own (indiv, ploidy, stop, anc)."""
    if n_anc is None:
        n_anc = 1 + (geno.agg(F.max(F.greatest("c0", "c1")).alias("m")).first()["m"] or 0)
    n_bits = max(1, n_anc.bit_length())  # codes from 1 on, 0 is missing
    code = {h: F.coalesce(F.col(f"c{h}").cast("int") + 1, F.lit(0)) for h in (0, 1)}
    planes = {f"p{h}_{k}": code[h].bitwiseAND(F.lit(1 << k)) != 0 for h in (0, 1) for k in range(n_bits)}
    words = packed_bits(geno, ["indiv"], {"present": F.lit(True)} | planes)
    words = words.select("indiv", "range", "present", *planes).repartition("indiv").sortWithinPartitions("indiv", "range")
    kind = geno.schema["indiv"].dataType.simpleString()

    def ancestry(code: np.ndarray) -> pa.Array:
        return pa.array((code - 1).astype(np.int32), mask=code == 0)

    def table(ploidy: int | None, who: pa.Array, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        if ploidy is None:
            return pa.RecordBatch.from_arrays([who, pa.array(start), pa.array(stop), ancestry(value & (1 << n_bits) - 1), ancestry(value >> n_bits)], ["indiv", "start", "stop", "anc0", "anc1"])
        return pa.RecordBatch.from_arrays([who, pa.array(np.full(len(who), ploidy, np.int32)), pa.array(stop), ancestry(value)], ["indiv", "ploidy", "stop", "anc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = {h: Runs() for h in ((0, 1) if each else (None,))}
        column = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            bits = lambda k: np.unpackbits(batch.column(k).to_numpy().astype("<i8").view(np.uint8), bitorder="little")  # noqa: E731, B023
            place = np.flatnonzero(bits(2))
            row = place // RANGE
            at = batch.column(1).to_numpy()[row] * RANGE + place % RANGE
            codes = [sum((bits(3 + h * n_bits + k)[place].astype(np.int64) << k for k in range(1, n_bits)), bits(3 + h * n_bits)[place].astype(np.int64)) for h in (0, 1)]
            for h, r in runs.items():
                yield table(h, *r.add(column, row, at, codes[0] | codes[1] << n_bits if h is None else codes[h]))
        if column is not None:
            for h, r in runs.items():
                yield table(h, *r.rest(column.type))

    ensure_on_workers(geno.sparkSession)
    return words.mapInArrow(run, f"indiv {kind}, " + ("ploidy int, stop long, anc int" if each else "start long, stop long, anc0 int, anc1 int"))


def encode(geno: DataFrame, n_anc: int | None = None) -> DataFrame:
    """Dense ancestry to segments: a break after each variant where either haplotype changes, and at the end.

    indiv, start, stop, anc0, anc1. A missing ancestry (null) is one of its own;
    variants that are left out break nothing. Without ``n_anc`` the largest code is
    looked up first.
    """
    return _ancestry_runs(geno, n_anc, False)


def with_starts(breaks: DataFrame, first: int = 0) -> DataFrame:
    """(indiv, stop, anc0, anc1) -> segments with ``start`` from the stop before."""
    start = F.lag("stop", 1, first).over(person())
    return breaks.select("indiv", start.cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "anc0", "anc1")


def decode(segments: DataFrame) -> DataFrame:
    """Segments to dense rows (snp, indiv, c0, c1), inside the scan's stage."""
    return segments.where("start < stop").select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("snp"), "indiv", F.col("anc0").alias("c0"), F.col("anc1").alias("c1"))


def subset(segments: DataFrame, start: Column | int, stop: Column | int) -> DataFrame:
    """Clip to [start, stop) and shift so that it begins at 0."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (start, stop))
    cut = segments.select("indiv", (F.greatest("start", lo) - lo).alias("start"), (F.least("stop", hi) - lo).alias("stop"), "anc0", "anc1")
    return cut.where("start < stop")


def clean(breaks: DataFrame, order: str = "idx") -> DataFrame:
    """Breaks (indiv, stop, anc0, anc1, idx): the first of equal breaks wins, break 0 goes."""
    first = F.row_number().over(Window.partitionBy("indiv", "stop").orderBy(order)) == 1
    return breaks.withColumn("_one", first).where("_one AND stop > 0").drop("_one", order)


def merge_runs(segments: DataFrame) -> DataFrame:
    """Join neighbours of equal ancestry; the last break of a run stays."""
    nxt = [F.lead(c).over(person()) for c in ("anc0", "anc1")]
    kept = segments.withColumn("_last", nxt[0].isNull() | (nxt[0] != F.col("anc0")) | (nxt[1] != F.col("anc1"))).where("_last")
    first = segments.groupBy("indiv").agg(F.min("start").alias("_first"))
    kept = kept.join(first, "indiv")
    return kept.select("indiv", F.coalesce(F.lag("stop").over(person()), F.col("_first")).alias("start"), "stop", "anc0", "anc1")


def haplotype_segments(geno: DataFrame, n_anc: int | None = None) -> DataFrame:
    """(indiv, ploidy, stop, anc): each haplotype's own breaks, among those of the person."""
    return _ancestry_runs(geno, n_anc, True)


class Pairs:
    """Breaks of two haplotypes in falling order to a person's segments; the last break stays open until the next batch."""

    def __init__(self) -> None:
        self.open: tuple[pa.Scalar, int, list[int], list[int]] | None = None  # person, stop, values at it, and those before it in this order

    def add(self, column: pa.Array, stop: np.ndarray, values: list[np.ndarray], end: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(persons, starts, stops, values) of the breaks that are complete. Values: that of a haplotype, NONE on other rows."""
        person = numbered(column, self.open[0] if self.open else None)
        row = np.arange(len(stop))
        if self.open:
            # Two rows ahead: the values carried along, at a break of their own, and the open break.
            person, row = np.concatenate(([0, 0], person)), np.concatenate(([-1, -1], row))
            stop = np.concatenate(([np.iinfo(np.int64).max, self.open[1]], stop))
            values = [np.concatenate(([self.open[3][h], self.open[2][h]], v)) for h, v in enumerate(values)]
        first = np.flatnonzero(np.concatenate(([True], (person[1:] != person[:-1]) | (stop[1:] != stop[:-1]))))
        person, stop, row = person[first], stop[first], row[first]
        values = [np.maximum.reduceat(v, first) for v in values]
        fresh = np.concatenate(([True], person[1:] != person[:-1]))
        filled = []
        for v in values:
            known = np.maximum.accumulate(np.where((v != NONE) | fresh, np.arange(len(v)), 0))
            filled.append(v[known])
        start = np.where(np.concatenate((fresh[1:], [True])), 0, np.concatenate((stop[1:], [0])))
        a, b = (1 if self.open else 0), len(stop) - (0 if end else 1)
        who = column.take(pa.array(row[a:b][row[a:b] >= 0]))
        if len(who) < b - a:
            who = pa.concat_arrays([pa.array([self.open[0].as_py()], column.type), who])
        out = who, start[a:b], stop[a:b], [f[a:b] for f in filled]
        if not end:
            before = [int(f[-2]) if len(f) > 1 and not fresh[-1] else NONE for f in filled]
            self.open = column[int(row[-1])] if row[-1] >= 0 else self.open[0], int(stop[-1]), [int(v[-1]) for v in values], before
        return out


#: No value of a haplotype.
NONE = np.iinfo(np.int32).min


def pair_haplotypes(haps: DataFrame) -> DataFrame:
    """(indiv, ploidy, stop, anc) of two haplotypes to diploid segments: union of breaks; each side's value is that of its
    next break at or after. A person's breaks are read in falling order, in Arrow batches, with what is carried along."""
    kind = haps.schema["indiv"].dataType.simpleString()
    rows = haps.select("indiv", F.col("ploidy").cast("int").alias("ploidy"), F.col("stop").cast("long").alias("stop"), F.col("anc").cast("int").alias("anc"))

    def table(who: pa.Array, start: np.ndarray, stop: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([who, pa.array(start), pa.array(stop), *[pa.array(v.astype(np.int32), mask=v == NONE) for v in values]], ["indiv", "start", "stop", "anc0", "anc1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, column = Pairs(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            column, ploidy = batch.column(0), batch.column(1).to_numpy()
            anc = batch.column(3).cast(pa.int64()).fill_null(NONE).to_numpy()
            yield table(*pairs.add(column, batch.column(2).to_numpy(), [np.where(ploidy == h, anc, NONE) for h in (0, 1)]))
        if column is not None:
            none = np.empty(0, np.int64)
            yield table(*pairs.add(column.slice(0, 0), none, [none, none], True))

    ensure_on_workers(haps.sparkSession)
    ordered = rows.repartition("indiv").sortWithinPartitions("indiv", F.desc("stop"))
    return ordered.mapInArrow(run, f"indiv {kind}, start long, stop long, anc0 int, anc1 int")


def concat(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Segments of consecutive stretches, each with its number of variants, shifted and put together; equal runs at a seam stay apart."""
    out, offset = None, 0
    for segments, n_snp in parts:
        shifted = segments.select("indiv", (F.col("start") + offset).alias("start"), (F.col("stop") + offset).alias("stop"), "anc0", "anc1")
        out = shifted if out is None else out.unionByName(shifted)
        offset += n_snp
    return out


def counts(segments: DataFrame, n_anc: int) -> DataFrame:
    """indiv, count1..countk: variants times haplotypes of each ancestry."""
    length = F.col("stop") - F.col("start")
    return segments.groupBy("indiv").agg(*[F.sum(length * ((F.col("anc0") == a).cast("int") + (F.col("anc1") == a).cast("int"))).alias(f"count{a + 1}") for a in range(n_anc)])


def proportions(segments: DataFrame, n_anc: int) -> DataFrame:
    """counts and prop1..propk of each person."""
    c = counts(segments, n_anc)
    all_ = sum((F.col(f"count{a + 1}") for a in range(1, n_anc)), F.col("count1"))
    return c.select("*", *[F.try_divide(F.col(f"count{a + 1}"), all_).alias(f"prop{a + 1}") for a in range(n_anc)])


def average_ancestry(segments: DataFrame) -> DataFrame:
    length = F.col("stop") - F.col("start")
    return segments.groupBy("indiv").agg(F.try_divide(F.sum(length * (F.col("anc0") + F.col("anc1"))), 2 * F.sum(length)).alias("avg_anc"))


def check(segments: DataFrame) -> DataFrame:
    """n_indiv, n_last (distinct last breaks; 1 if well formed), n_gap (starts that don't meet the break before)."""
    gap = (F.coalesce(F.lag("stop").over(person()), F.lit(0)) != F.col("start")).cast("long")
    per = segments.withColumn("_gap", gap).groupBy("indiv").agg(F.max("stop").alias("_last"), F.sum("_gap").alias("_gaps"))
    return per.agg(F.count("*").alias("n_indiv"), F.countDistinct("_last").alias("n_last"), F.sum("_gaps").alias("n_gap"))


def nearest_source(source: DataFrame, target: DataFrame) -> DataFrame:
    """(chrom, pos) of target -> (chrom, pos, source_idx): the nearest source variant of the chromosome, ties to the smaller.

    An as-of join by window: both tables are laid on one line per chromosome and
    the last source before and the first after are carried along.
    """
    both = target.select("chrom", "pos", F.lit(None).cast("long").alias("idx"), F.lit(None).cast(source.schema["pos"].dataType).alias("spos")).unionByName(
        source.select("chrom", "pos", F.col("idx").cast("long").alias("idx"), F.col("pos").alias("spos"))
    )
    line = Window.partitionBy("chrom").orderBy("pos")
    before = line.rangeBetween(Window.unboundedPreceding, 0)
    after = line.rangeBetween(0, Window.unboundedFollowing)
    # Of sources at one position the smaller index is taken.
    low, high = F.struct("spos", (-F.col("idx")).alias("n")), F.struct("spos", "idx")
    near = both.select("chrom", "pos", "idx", F.max(F.when(F.col("idx").isNotNull(), low)).over(before).alias("_b"), F.min(F.when(F.col("idx").isNotNull(), high)).over(after).alias("_a"))
    left, right = F.col("pos") - F.col("_b.spos"), F.col("_a.spos") - F.col("pos")
    pick = F.when(F.col("_a").isNull() | (F.col("_b").isNotNull() & (left <= right)), -F.col("_b.n")).otherwise(F.col("_a.idx"))
    return near.where("idx IS NULL").select("chrom", "pos", pick.alias("source_idx"))


def impute(segments: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Segments over the source variants (idx, chrom, pos) to segments over the target variants: each target variant takes
    the ancestry of its nearest source variant, so a segment's stop is the number of targets whose source lies before it."""
    mapped = nearest_source(source, target.select("chrom", "pos").distinct()).join(target.select("chrom", "pos", F.col("idx").alias("_t")), ["chrom", "pos"])
    # For every source index: how many targets map to a smaller one (targets keep file order, so the map is monotone).
    per = mapped.groupBy("source_idx").agg(F.count("*").alias("_n"))
    upto = source.select(F.col("idx").cast("long").alias("_idx")).join(per, F.col("_idx") == F.col("source_idx"), "left")
    upto = running_sum(upto, F.coalesce("_n", F.lit(0)), ["_idx"], "_new").select((F.col("_idx") + 1).alias("_stop"), "_new")
    moved = segments.join(upto, F.col("stop") == F.col("_stop")).select("indiv", F.col("_new").alias("stop"), "anc0", "anc1", F.col("stop").alias("idx"))
    return merge_runs(with_starts(clean(moved)))
