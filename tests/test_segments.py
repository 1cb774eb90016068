"""Segment algebra against dense ancestry and worked examples."""

import numpy as np
import pytest

from mosaica.operators import segments as S

F2 = [(0, 0, 1, 0, 0), (0, 1, 2, 1, 1), (0, 2, 4, 2, 2), (1, 0, 2, 3, 3), (1, 2, 4, 4, 4)]
SEG = "indiv long, start long, stop long, anc0 int, anc1 int"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def dense(df):
    out = {}
    for r in S.decode(df).collect():
        out[(r["indiv"], r["snp"])] = (r["c0"], r["c1"])
    return out


def test_decode_then_encode(spark):
    seg = spark.createDataFrame(F2, SEG)
    d = dense(seg)
    assert [d[(0, s)][0] for s in range(4)] == [0, 1, 2, 2]
    assert [d[(1, s)][0] for s in range(4)] == [3, 3, 4, 4]
    assert rows(S.encode(S.decode(seg)), "indiv", "start", "stop", "anc0", "anc1") == sorted(F2)


def test_subset_and_concat(spark):
    seg = spark.createDataFrame(F2, SEG)
    part = S.subset(seg, 2, 4)
    d = dense(part)
    assert [d[(0, s)][0] for s in range(2)] == [2, 2] and [d[(1, s)][0] for s in range(2)] == [4, 4]
    both = dense(S.concat([(seg, 4), (part, 2)]))
    assert [both[(0, s)][0] for s in range(6)] == [0, 1, 2, 2, 2, 2]


def test_concat_shifts_without_merging(spark):
    a = spark.createDataFrame([(0, 0, 1, 0, 1), (0, 1, 15, 0, 0)], SEG)
    b = spark.createDataFrame([(0, 0, 3, 0, 1), (0, 3, 12, 0, 1)], SEG)
    assert rows(S.concat([(a, 15), (b, 12)]), "stop", "anc0", "anc1") == [(1, 0, 1), (15, 0, 0), (18, 0, 1), (27, 0, 1)]


def test_clean(spark):
    raw = "indiv long, idx long, stop long, anc0 int, anc1 int"
    one = spark.createDataFrame([(0, 1, 50, 0, 1), (0, 2, 100, 0, 1), (0, 3, 300, 0, 0)], raw)
    assert rows(S.merge_runs(S.with_starts(S.clean(one))), "stop", "anc0", "anc1") == [(100, 0, 1), (300, 0, 0)]
    two = spark.createDataFrame([(0, 1, 50, 0, 1), (0, 2, 100, 0, 1), (0, 3, 100, 1, 0), (0, 4, 300, 0, 0), (0, 5, 300, 0, 1)], raw)
    assert rows(S.merge_runs(S.with_starts(S.clean(two))), "stop", "anc0", "anc1") == [(100, 0, 1), (300, 0, 0)]


@pytest.mark.parametrize(
    "source, target, expected",
    [
        ([1, 4, 7], [3, 4, 7], [1, 1, 2]), ([1, 4, 7], [2, 5, 8], [0, 1, 2]), ([1, 4, 7], [1, 4, 7], [0, 1, 2]), ([1, 4, 7], [7, 8, 9], [2, 2, 2]),
        ([1, 4, 7], [-2, -1, 0], [0, 0, 0]), ([1, 4, 7], [0, 1, 7], [0, 0, 2]), ([1, 5, 9], [3, 5, 7], [0, 1, 1]), ([1, 8, 9], [1, 6, 9], [0, 1, 2]),
    ],
)
def test_nearest(spark, source, target, expected):
    s = spark.createDataFrame([(i, 1, p) for i, p in enumerate(source)], "idx long, chrom int, pos long")
    t = spark.createDataFrame([(1, p) for p in target], "chrom int, pos long")
    assert [r["source_idx"] for r in S.nearest_source(s, t).orderBy("pos").collect()] == expected


def test_nearest_stays_on_its_chromosome(spark):
    s = spark.createDataFrame([(0, 1, 1), (1, 1, 5), (2, 2, 9)], "idx long, chrom int, pos long")
    t = spark.createDataFrame([(1, 4), (2, 5), (2, 7)], "chrom int, pos long")
    assert [r["source_idx"] for r in S.nearest_source(s, t).orderBy("chrom", "pos").collect()] == [1, 2, 2]


def test_impute(spark):
    seg = spark.createDataFrame(F2, SEG)
    source = spark.createDataFrame([(i, 1, p) for i, p in enumerate([1, 4, 7, 10])], "idx long, chrom int, pos long")
    same = spark.createDataFrame([(i, 1, p) for i, p in enumerate([2, 5, 8, 11])], "idx long, chrom int, pos long")
    assert dense(S.impute(seg, source, same)) == dense(seg)
    moved = spark.createDataFrame([(i, 1, p) for i, p in enumerate([3, 4, 7, 10])], "idx long, chrom int, pos long")
    d = dense(S.impute(seg, source, moved))
    assert d[(0, 0)] == (1, 1) and d[(0, 1)] == (1, 1) and d[(0, 2)] == (2, 2)


def test_random_panel(spark):
    rng = np.random.default_rng(0)
    c = (rng.random((6, 40, 2)).cumsum(axis=1) * 0.7).astype(int) % 3
    geno = spark.createDataFrame([(s, i, int(c[i, s, 0]), int(c[i, s, 1])) for i in range(6) for s in range(40)], "snp long, indiv long, c0 int, c1 int")
    seg = S.encode(geno)
    assert dense(seg) == {(i, s): tuple(map(int, c[i, s])) for i in range(6) for s in range(40)}
    assert rows(S.pair_haplotypes(S.haplotype_segments(geno)), "indiv", "start", "stop", "anc0", "anc1") == rows(seg, "indiv", "start", "stop", "anc0", "anc1")
    for r in S.counts(seg, 3).collect():
        assert [r[f"count{a + 1}"] for a in range(3)] == [(c[r["indiv"]] == a).sum() for a in range(3)]
    assert S.check(seg).first().asDict() == {"n_indiv": 6, "n_last": 1, "n_gap": 0}


def test_runs_over_many_batches(spark):
    rng = np.random.default_rng(4)
    m, n = 300, 5
    c = np.where(rng.random((n, 2, m)) < 0.1, 1, 0).cumsum(axis=2) % 3
    codes = {(i, s): tuple(None if rng.random() < 0.02 else int(c[i, h, s]) for h in (0, 1)) for i in range(n) for s in range(m) if rng.random() < 0.8 and not (i == 1 and 64 <= s < 200)}
    geno = spark.createDataFrame([(s, i, *v) for (i, s), v in codes.items()], "snp long, indiv long, c0 int, c1 int")
    want, haps = [], []
    for i in range(n):
        at = [s for s in range(m) if (i, s) in codes]
        last = at[0]
        for s, nxt in zip(at, [*at[1:], None], strict=True):
            if nxt is None or codes[i, s] != codes[i, nxt]:
                want.append((i, last, s + 1, *codes[i, s]))
                last = s + 1
            haps += [(i, h, s + 1, codes[i, s][h]) for h in (0, 1) if nxt is None or codes[i, s][h] != codes[i, nxt][h]]
    full = [(i, h, s, a) for i, h, s, a in haps if a is not None]
    paired = []
    for i in range(n):
        stops = sorted({s for j, _, s, _ in haps if j == i})
        side = [next((a for j, h, t, a in sorted(full, key=lambda x: x[2]) if (j, h) == (i, k) and t >= s), None) for s in stops for k in (0, 1)]
        paired += [(i, b, s, *side[2 * k : 2 * k + 2]) for k, (b, s) in enumerate(zip([0, *stops[:-1]], stops, strict=True))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        segments, breaks = S.encode(geno), S.haplotype_segments(geno)
        assert sorted(map(str, segments.collect())) == sorted(map(str, spark.createDataFrame(want, SEG).collect()))
        assert sorted(map(str, breaks.collect())) == sorted(map(str, spark.createDataFrame(haps, "indiv long, ploidy int, stop long, anc int").collect()))
        pairs = S.pair_haplotypes(breaks)
        assert sorted(map(str, pairs.collect())) == sorted(map(str, spark.createDataFrame(paired, SEG).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Breaks are found along a person's words, not by windows over breaks.
    assert "Window" not in pairs._jdf.queryExecution().toString()
