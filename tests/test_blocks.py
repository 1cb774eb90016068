"""Packed ancestry and blocked reference scores: range edges, gaps, missing codes, small blocks; modules define a name once."""

import ast
from pathlib import Path

import numpy as np
import pytest

from mosaica.operators import scores, segments

ROOT = Path(__file__).resolve().parent.parent


def by_hand(rows):
    """(snp, indiv, c0, c1) to segments, person by person."""
    out = []
    for person in sorted({r[1] for r in rows}):
        own = sorted(r for r in rows if r[1] == person)
        start = own[0][0]
        for k, r in enumerate(own):
            if k + 1 == len(own) or own[k + 1][2:] != r[2:]:
                out.append((person, start, r[0] + 1, *r[2:]))
                start = r[0] + 1
    return out


def key(row):
    return tuple(-1 if x is None else x for x in row)


@pytest.mark.parametrize("case", ["edges", "random", "gaps", "missing", "one"])
def test_encode_across_ranges(spark, case):
    rng = np.random.default_rng(7)
    n = 5 * segments.RANGE + 3
    c = rng.integers(0, 3, (n, 4, 2)) if case == "random" else np.zeros((n, 4, 2), int)
    if case == "edges":  # a change on every edge of a range, and on both of its sides
        for person, shift in enumerate((-1, 0, 1)):
            for k, s in enumerate(range(segments.RANGE + shift, n, segments.RANGE)):
                c[s:, person, k % 2] = 1 - c[s - 1, person, k % 2]
    if case in ("gaps", "missing"):
        c = np.repeat(rng.integers(0, 6, (n // 9 + 1, 4, 2)), 9, axis=0)[:n]
    rows = [(s, i, int(c[s, i, 0]), int(c[s, i, 1])) for s in range(n) for i in range(4) if case != "gaps" or (rng.random() < 0.3 and not 100 < s < 260)]
    if case == "missing":
        rows = [(s, i, None if a == 5 else a, b) for s, i, a, b in rows]
    if case == "one":
        rows = [(63, 0, 1, 0), (64, 1, 0, 0), (200, 1, 0, 0)]
    geno = spark.createDataFrame(rows, "snp long, indiv long, c0 int, c1 int").repartition(5)
    for n_anc in (None, 6):
        got = segments.encode(geno, n_anc).select("indiv", "start", "stop", "anc0", "anc1").collect()
        assert sorted(map(key, got)) == sorted(map(key, by_hand(rows)))
    assert segments.encode(geno.limit(0)).count() == 0


def test_only_packed_rows_are_shuffled(spark):
    n, people = 64 * 20, 30
    geno = spark.range(n * people).selectExpr(f"id DIV {people} AS snp", f"id % {people} AS indiv", "CAST(id DIV 977 % 2 AS INT) AS c0", "0 AS c1").repartitionByRange(4, "snp").sortWithinPartitions("snp")
    found = segments.encode(geno, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Exchange rangepartitioning(snp" in plan  # the last is the test's own
    below = plan.index("partial_bit_or")
    assert plan.rindex("Exchange hashpartitioning(indiv", 0, below) < below
    assert segments.packed_bits(geno, ["indiv"], {"x": geno.c0 == 1}).count() == people * n // segments.RANGE


@pytest.mark.parametrize(("haplotypes", "people"), [(256, 16_384), (3, 2)])
def test_reference_scores_of_small_blocks(spark, haplotypes, people):
    rng = np.random.default_rng(8)
    n = 3 * segments.RANGE + 5
    c = np.repeat(rng.integers(0, 3, (n // 5 + 1, 7, 2)), 5, axis=0)[:n]
    c[:, 6] = 0  # all of one ancestry: zero scores by the others' haplotypes
    w = rng.normal(size=n)
    a = rng.integers(0, 2, (n, 5, 2))
    a[:, 4] = 0  # a haplotype without an allele
    geno = spark.createDataFrame([(s, i, int(c[s, i, 0]), int(c[s, i, 1])) for s in range(n) for i in range(7)], "snp long, indiv long, c0 int, c1 int")
    weights = spark.createDataFrame([(s, float(w[s])) for s in range(n) if s % 11], "snp long, weight double")
    rows = [(k, i, h, s, None if s == 8 else int(a[s, i, h])) for k in (0, 1) for i in range(5) for h in (0, 1) for s in range(n)]
    ref = spark.createDataFrame(rows, "anc int, ref long, ploidy int, snp long, allele int")
    got = {(r["indiv"], r["anc"], r["ref"], r["ploidy"]): r["score"] for r in scores.reference_scores(segments.encode(geno), ref, weights, haplotypes, people).collect()}
    assert len(got) == 7 * 2 * 5 * 2
    use = w * (np.arange(n) % 11 > 0) * (np.arange(n) != 8)
    for (i, k, r, h), score in got.items():
        assert score == pytest.approx(((c[:, i] == k).sum(axis=1) * a[:, r, h] * use).sum())
    assert scores.reference_scores(segments.encode(geno), ref.limit(0), weights).count() == 0


def test_no_name_is_defined_twice():
    for path in sorted((ROOT / "mosaica").rglob("*.py")):
        tree = ast.parse(path.read_text())
        for body in [tree.body, *(node.body for node in tree.body if isinstance(node, ast.ClassDef))]:
            names = [node.name for node in body if isinstance(node, (ast.FunctionDef, ast.ClassDef))]
            assert len(names) == len(set(names)), (path, names)
